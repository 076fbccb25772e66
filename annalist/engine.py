"""The facade: ingest, discover, read and correct over a folder of append-only tables.

Evidence, lifecycle events, accepted revisions and rejections are only ever appended to. Everything
else is derived and lives in numbered generations: a rebuild writes a new one beside the old and is
finished by one small pointer file, so a run that breaks off leaves the last whole generation in use.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import asdict, dataclass
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from annalist.functions.text import content_hash
from annalist.operators import compilation, linegraph, nearline, revisions, search, similarity, snapshots, structure, surface, trajectory, visibility
from annalist.streaming import compile as streaming

EVIDENCE = (
    "lineage_id string, evidence_id string, ordering_key string, subject string, content string, occurred_at timestamp, known_at timestamp, "
    "topics array<string>, recap boolean, provenance map<string,string>"
)
ITEMS = f"lineage_id string, {streaming.ITEM}"
LIFECYCLE = "evidence_id string, event_id string, event_type string, event_at timestamp, replacement string"
BASELINES = "baseline_id string, region_id string, revision_number int, previous_baseline_id string, content string, support array<string>, action string"
REJECTIONS = "region_id string, content_hash string, support_signature string, reopened_at timestamp"
GENERATIONS = "generation int, fingerprint string"
SNAPSHOTS = "snapshot_id string, cutoff timestamp"
OBSERVED = "generation int, step int"
POSTINGS = "evidence_id string, kind string, holder_id string"


@dataclass(frozen=True)
class Settings:
    schema: str = "1"
    embedding: str = "hash-16"
    scales: tuple[int, ...] = structure.SCALES
    least_structure: float = structure.LEAST
    neighbours: int = trajectory.K
    least_similarity: float = trajectory.LEAST_SIMILARITY
    least_support: int = trajectory.LEAST_SUPPORT


class Engine:
    def __init__(self, spark: SparkSession, root: str, settings: Settings = Settings()):
        self.spark, self.root, self.settings = spark, root.rstrip("/"), settings

    def read(self, name: str, schema: str) -> DataFrame:
        """An append-only table; empty where nothing was written yet."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        there = path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path)
        return self.spark.read.schema(schema).parquet(f"{self.root}/{name}") if there else self.spark.createDataFrame([], schema)

    def append(self, rows: DataFrame, name: str, schema: str) -> None:
        columns = self.spark.createDataFrame([], schema).schema
        rows.select(*(F.col(f.name).cast(f.dataType).alias(f.name) for f in columns)).write.mode("append").parquet(f"{self.root}/{name}")

    @cached_property
    def fingerprint(self) -> str:
        return revisions.derivation_fingerprint(self.spark, {k: str(v) for k, v in asdict(self.settings).items()}).first()[0]

    # Ingest -----------------------------------------------------------------------------------------

    def ingest(self, batch: DataFrame) -> int:
        """Admit new evidence; the number of rows that were new. An id with other content, and a row without a canonical source, raise."""
        old = self.read("evidence", EVIDENCE)
        full = batch.select(*(F.col(c) if c in batch.columns else F.lit(None).cast(t).alias(c) for c, t in old.dtypes))
        new = visibility.admit_or_raise(full, old)
        self.append(new, "evidence", EVIDENCE)
        return self.read("evidence", EVIDENCE).count() - old.count()

    def process(self, items: DataFrame, provider: Callable | None = None) -> DataFrame:
        """Admit items and compile them right away, one after the other in each lineage; what came of them, of this call alone.

        An item that fails blocks its lineage: give it again, and what waits behind it follows. A call that dies is finished by
        the next one; a batch appears once.
        """
        self.ingest(items)
        before = streaming.committed(self.spark, f"{self.root}/processed").select("batch_id")
        names = [c.split()[0] for c in ITEMS.split(", ")]
        full = items.select(*(F.col(c) if c in items.columns else F.lit(None).alias(c) for c in names))
        self.append(visibility.with_effective_times(full.withColumn("recap", F.coalesce("recap", F.lit(False)))), "incoming", ITEMS)
        arriving = self.spark.readStream.schema(ITEMS).parquet(f"{self.root}/incoming")
        known = before.collect()  # one number a batch
        streaming.process(arriving, f"{self.root}/processed", provider).awaitTermination()
        last = max((r.batch_id for r in known), default=-1)
        return streaming.read_states(self.spark, f"{self.root}/processed").filter(F.col("batch_id") > last).drop("batch_id")

    def invalidate(self, ids: DataFrame, at: str) -> None:
        """Record that evidence is invalid from ``at`` on; what was recorded before stays."""
        new = revisions_event(visibility.invalidate(self.read("lifecycle", LIFECYCLE), ids, F.lit(at).cast("timestamp")))
        self.append(new, "lifecycle", LIFECYCLE)

    def supersede(self, replacements: DataFrame, at: str) -> None:
        """Record that evidence is replaced (evidence_id, replacement) from ``at`` on; repeating a pair changes nothing.

        Both must exist and the replacement be valid now, else it raises and nothing is recorded.
        """
        log = self.read("lifecycle", LIFECYCLE)
        new = visibility.supersede(self.read("evidence", EVIDENCE), log, replacements, F.lit(at).cast("timestamp"))
        new = new.join(log.filter("event_type = 'SUPERSEDED'").select("evidence_id", "replacement"), ["evidence_id", "replacement"], "left_anti")
        self.append(new.withColumn("event_id", F.concat_ws("/", "evidence_id", "replacement", F.col("event_at").cast("string"))), "lifecycle", LIFECYCLE)

    # Derive -----------------------------------------------------------------------------------------

    def rebuild(self) -> int:
        """Compile and discover from the source tables into a new generation; its number."""
        s, number = self.settings, self.generation() + 1
        evidence, log = self.read("evidence", EVIDENCE), self.read("lifecycle", LIFECYCLE)
        made = compilation.compile_batch(evidence.select("lineage_id", "evidence_id", "ordering_key", "subject", "content", "occurred_at", "known_at", "topics", F.coalesce("recap", F.lit(False)).alias("recap")))
        states = made.filter(F.col("action").isin(*compilation.MADE)).withColumn("state_id", F.concat_ws("@", "block_id", "state_version"))
        self.put(similarity.embed(states, given=None), "states", number)
        self.put(made.filter(~F.col("action").isin(*compilation.MADE)).select("lineage_id", "evidence_id", "action", "failure"), "quarantine", number)
        states = self.derived("states", number)
        good = states.join(self.broken(states, log), "state_id", "left_anti")
        heads = visibility.latest(good)
        uses = lambda rows: rows.select(F.col("block_id").alias("holder_id"), F.col("raw_evidence_ids").alias("evidence_ids"))
        self.put(revisions.postings({"block": uses(states), "point": uses(heads)}).repartition("evidence_id").sortWithinPartitions("evidence_id"), "postings", number)
        points = heads.select(F.col("block_id").alias("id"), "vector", F.to_date("occurred_start").alias("occurred_on"), "occurred_start", "occurred_end")
        self.put(points, "points", number)
        points = self.derived("points", number)
        self.put(structure.enrich(structure.observations(points, s.scales, s.least_structure)), "observations", number)
        edges = trajectory.orient(similarity.mutual_edges(similarity.exact_knn(points, s.neighbours, s.least_similarity)), points)
        self.put(edges, "edges", number)
        edges = self.derived("edges", number)
        found = trajectory.propose(edges, least_support=s.least_support)
        kept = trajectory.maximal_paths(found.select("nodes"), s.least_support).join(found.select("component", "nodes"), "nodes")
        rests = self.derived("points", number).select(F.col("id").alias("node")).join(heads.select(F.col("block_id").alias("node"), F.explode("raw_evidence_ids").alias("evidence_id")), "node")
        parts = found.select("component", F.explode("nodes").alias("node")).distinct()
        evidence = parts.join(rests, "node").select("component", F.col("node").alias("block_id"), "evidence_id")
        self.put(trajectory.bootstrap_lines(trajectory.described(kept, edges, points), evidence, seed=s.least_support), "lines", number)
        self.append(self.spark.createDataFrame([(number, self.fingerprint)], GENERATIONS), "generations", GENERATIONS)
        return number

    def line_tables(self) -> tuple[DataFrame, DataFrame]:
        """(members, edges): the revisions of lines, from the last whole generation and what was observed since."""
        self.derived("lines")  # refuses tables of other settings
        number = self.generation()
        steps = self.read("observed", OBSERVED).filter(F.col("generation") == number).agg(F.max("step")).first()[0]
        if steps is not None:
            return tuple(self.spark.read.parquet(f"{self.root}/generation-{number}/observed-{steps}/{name}") for name in ("members", "edges"))
        node = lambda block: linegraph.node_id(F.col("line_id"), F.col(block))
        states = self.derived("states")
        heads = visibility.latest(states.join(self.broken(states, self.read("lifecycle", LIFECYCLE)), "state_id", "left_anti"))
        never = F.lit(None).cast("timestamp").alias("retired_at")
        lines = self.derived("lines")
        members = lines.join(heads, "block_id").select("line_id", node("block_id").alias("node_id"), "block_id", "state_id", "vector", "occurred_start", "occurred_end", F.col("derived_known_at").alias("known_at"), never)
        ends = lambda name: members.select("line_id", F.col("block_id").alias(name), F.col("known_at").alias(f"{name}_known"))
        both = self.derived("edges").join(ends("parent"), "parent").join(ends("child"), ["line_id", "child"])
        edges = both.select("line_id", node("parent").alias("parent"), node("child").alias("child"), F.greatest("parent_known", "child_known").alias("known_at"), never)
        return members, edges

    def observe(self, items: DataFrame, at: str, provider: Callable | None = None) -> DataFrame:
        """Process items and let their blocks grow the lines that exist, as known from ``at`` on; what changed.

        (line_id, change, parent, child), see :func:`annalist.operators.nearline.observe`. Nothing is rebuilt: both tables of
        revisions get a new version beside the old, and its line in a pointer table comes last.
        """
        members, edges = self.line_tables()
        made = self.process(items, provider).filter(F.col("action").isin(*compilation.MADE))
        fresh = similarity.embed(visibility.latest(made), given=None)
        arriving = fresh.select("block_id", F.concat_ws("@", "block_id", "state_version").alias("state_id"), "vector", "occurred_start", "occurred_end", F.unix_micros("occurred_start").alias("ordinal"))
        members, edges, changes = nearline.observe(members, edges, arriving, F.lit(at).cast("timestamp"), self.settings.least_similarity)
        number = self.generation()
        step = self.read("observed", OBSERVED).filter(F.col("generation") == number).agg(F.coalesce(F.max("step"), F.lit(0)) + 1).first()[0]
        self.put(members, f"observed-{step}/members", number)
        self.put(edges, f"observed-{step}/edges", number)
        self.append(self.spark.createDataFrame([(number, step)], OBSERVED), "observed", OBSERVED)
        return changes

    def broken(self, states: DataFrame, log: DataFrame) -> DataFrame:
        gone = log.filter(F.col("event_type").isin("INVALIDATED", "SUPERSEDED")).select("evidence_id").distinct()
        return compilation.bridge(states).join(gone, "evidence_id", "left_semi").select("state_id").distinct()

    def put(self, rows: DataFrame, name: str, number: int) -> None:
        rows.write.mode("overwrite").parquet(f"{self.root}/generation-{number}/{name}")

    def generation(self) -> int:
        return self.read("generations", GENERATIONS).agg(F.coalesce(F.max("generation"), F.lit(0))).first()[0]

    def derived(self, name: str, number: int | None = None) -> DataFrame:
        """A derived table of a generation; without a number of the last whole one, if settings still fit it."""
        if number is None:
            last = self.read("generations", GENERATIONS).orderBy(F.desc("generation")).limit(1).collect()
            if not last or last[0].fingerprint != self.fingerprint:
                raise RuntimeError("derived tables are missing or of other settings; call rebuild()")
            number = last[0].generation
        return self.spark.read.parquet(f"{self.root}/generation-{number}/{name}")

    def run_batch(self, batch: DataFrame) -> int:
        self.ingest(batch)
        return self.rebuild()

    def invalidate_and_rebuild(self, ids: DataFrame, at: str) -> DataFrame:
        """Record the invalidation, rebuild, and return what it touched: (kind, holder_id)."""
        closure = self.closure(ids)
        self.invalidate(ids, at)
        self.rebuild()
        return closure

    def closure(self, ids: DataFrame) -> DataFrame:
        """(kind, holder_id) of the blocks, snapshots and accepted revisions that use the evidence: one lookup in the index.

        A generation brings the index of its blocks; snapshots and accepted revisions add theirs when they are kept, so
        revisions of any age are found.
        """
        blocks = self.derived("postings").filter("kind = 'block'")
        return revisions.holders_of(ids, blocks.unionByName(self.read("postings", POSTINGS)))

    # Snapshots --------------------------------------------------------------------------------------

    def put_snapshot(self, cutoff: str) -> str:
        """Keep the current observations as a snapshot at ``cutoff``; its id. The same points, cutoff and settings give one snapshot."""
        at = F.lit(cutoff).cast("timestamp")
        name = structure.snapshot_id(self.derived("points"), at, self.fingerprint).first()[0]
        if self.snapshots().filter(F.col("snapshot_id") == name).isEmpty():
            self.derived("observations").write.mode("overwrite").parquet(f"{self.root}/snapshots/{name}")
            shown = self.derived("postings").filter("kind = 'point'").select("evidence_id", F.lit(name).alias("holder_id"))
            self.append(revisions.postings({"snapshot": shown}), "postings", POSTINGS)
            self.append(self.spark.range(1).select(F.lit(name).alias("snapshot_id"), at.alias("cutoff")), "snapshot-catalogue", SNAPSHOTS)
        return name

    def snapshots(self) -> DataFrame:
        """(snapshot_id, cutoff), to be ordered by both."""
        return self.read("snapshot-catalogue", SNAPSHOTS)

    def snapshot(self, snapshot_id: str) -> DataFrame:
        """A snapshot's observations, with their stability against the snapshot before it; an unknown id raises."""
        known = snapshots.with_previous(self.snapshots()).filter(F.col("snapshot_id") == snapshot_id).collect()
        if not known:
            raise KeyError(snapshot_id)
        read = lambda name: self.spark.read.parquet(f"{self.root}/snapshots/{name}").withColumn("snapshot_id", F.lit(name))
        here = [name for name in (snapshot_id, known[0].previous_id) if name]
        rows = [read(name) for name in here]
        both = rows[0] if len(rows) == 1 else rows[0].unionByName(rows[1])
        return snapshots.stability(both.drop("stability"), self.snapshots().filter(F.col("snapshot_id").isin(here))).filter(F.col("snapshot_id") == snapshot_id)

    # Read -------------------------------------------------------------------------------------------

    def blocks_at(self, at: str) -> DataFrame:
        """Blocks as known at ``at``: states then known whose every evidence was valid then."""
        states = self.derived("states")
        return visibility.at_knowledge_cutoff(states, compilation.bridge(states), self.read("evidence", EVIDENCE), self.read("lifecycle", LIFECYCLE), F.lit(at).cast("timestamp"))

    def diff(self, before: int, after: int) -> DataFrame:
        return structure.diff(self.derived("observations", before), self.derived("observations", after))

    def line_frontier(self) -> DataFrame:
        nodes = self.derived("lines").select(F.col("block_id").alias("node_id")).distinct()
        return linegraph.frontier(nodes, self.derived("edges"))

    def project_line(self, vector: list[float], most_nodes: int = 6) -> tuple[DataFrame, DataFrame]:
        wanted = self.spark.createDataFrame([(vector,)], "vector array<double>")
        bridge = self.derived("states").select(F.col("block_id").alias("node_id"), F.explode("raw_evidence_ids").alias("evidence_id"))
        return linegraph.projection(self.derived("points").select(F.col("id").alias("node_id"), "vector"), self.derived("edges"), wanted, bridge, most_nodes)

    def surfaces(self) -> DataFrame:
        """Shapes that lines share, over each line's blocks in time order."""
        rows = self.derived("lines").join(self.derived("points").withColumnRenamed("id", "block_id"), "block_id")
        ordered = rows.groupBy("line_id").agg(F.array_sort(F.collect_list(F.struct("occurred_start", "block_id", "vector"))).alias("x")).filter(F.size("x") >= surface.LEAST_NODES)
        return surface.surfaces(surface.signatures(ordered.select("line_id", F.transform("x", lambda s: s["block_id"]).alias("node_ids"), F.transform("x", lambda s: s["vector"]).alias("vectors"))))

    def heads(self) -> DataFrame:
        return revisions.heads(self.read("baselines", BASELINES))

    def served(self) -> DataFrame:
        """Accepted heads whose states all exist with valid evidence and that no standing rejection covers."""
        states = self.derived("states")
        good = states.join(self.broken(states, self.read("lifecycle", LIFECYCLE)), "state_id", "left_anti").select("state_id", F.col("content").alias("state_content"), "raw_evidence_ids")
        rows = self.heads().withColumn("wanted", F.size("support")).withColumn("state_id", F.explode("support")).join(good, "state_id")
        whole = rows.groupBy("baseline_id", "region_id", "revision_number", "content", "wanted").agg(
            F.count("*").alias("n"), F.array_sort(F.collect_set("state_id")).alias("states"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("raw_evidence_ids")))).alias("sources"),
            F.array_join(F.array_sort(F.collect_list("state_content")), " ").alias("texts"),
        )
        return revisions.suppress(whole.filter("n = wanted").drop("n", "wanted"), self.rejections())

    def query(self, text: str) -> DataFrame:
        """Accepted understandings that share a token with the text; all of them for an empty text."""
        rows = self.served()
        asked = self.spark.createDataFrame([(0, text)], "query_id int, query_text string")
        hit = search.matches(rows.select("region_id", F.concat_ws(" ", "content", "texts").alias("content")), asked).select("region_id").distinct()
        return rows.join(hit, "region_id", "left_semi").select("region_id", "revision_number", "baseline_id", "content", "states", "sources").orderBy("region_id", "revision_number")

    # Accept and reject ------------------------------------------------------------------------------

    def accept(self, proposals: DataFrame) -> DataFrame:
        """Consolidate proposals (region_id, content, support: state ids) and append what is new; all with their action.

        States of the current generation with valid evidence are authorized: support by others comes back as UNAUTHORIZED
        and is not appended. A state that is not there raises.
        """
        every = self.derived("states")
        states = every.select("state_id").distinct()
        foreign = proposals.select(F.explode("support").alias("state_id")).join(states, "state_id", "left_anti")
        if not foreign.isEmpty():
            raise ValueError("support names states that do not exist")
        heads = self.heads()
        stale = self.broken(every, self.read("lifecycle", LIFECYCLE))
        lost = proposals.select("region_id", F.explode("support").alias("state_id")).join(stale, "state_id", "left_semi").groupBy("region_id").agg(F.collect_set("state_id").alias("lost"))
        proposals = proposals.join(lost, "region_id", "left").withColumn("authorized", F.when(F.col("lost").isNull(), F.col("support")).otherwise(F.array_except("support", "lost"))).drop("lost")
        judged = revisions.consolidate(proposals, heads)
        new = revisions.promote(proposals, heads).join(heads.select("region_id", F.col("baseline_id").alias("previous_baseline_id")), "region_id", "left")
        rows = judged.select("region_id", "action", "revision_number").collect()  # one row per proposal
        used = new.select(F.col("baseline_id").alias("holder_id"), F.explode("support").alias("state_id")).join(compilation.bridge(every), "state_id")
        self.append(revisions.postings({"baseline": used.select("holder_id", "evidence_id")}), "postings", POSTINGS)  # before the revisions: an index may name too much, never too little
        self.append(new, "baselines", BASELINES)
        return self.spark.createDataFrame(rows, "region_id string, action string, revision_number int")

    def reject(self, region_id: str) -> None:
        row = self.served().filter(F.col("region_id") == region_id).select("region_id", content_hash("content").alias("content_hash"), revisions.signature(F.col("sources")).alias("support_signature"), F.lit(None).cast("timestamp").alias("reopened_at"))
        self.append(row, "rejections", REJECTIONS)

    def rejections(self) -> DataFrame:
        """Each rejection as it stands now: ``reopened_at`` is null while it was rejected more often than reopened."""
        log = self.read("rejections", REJECTIONS)
        open_ = F.count("*") - F.count("reopened_at") > F.count("reopened_at")
        return log.groupBy("region_id", "content_hash", "support_signature").agg(F.when(~open_, F.max("reopened_at")).alias("reopened_at"))

    def reopen(self, region_id: str, at: str) -> None:
        """Let a region's rejected understandings be served again; raises where no rejection stands."""
        standing = self.rejections().filter((F.col("region_id") == region_id) & F.col("reopened_at").isNull())
        if standing.isEmpty():
            raise ValueError("no rejection of this region stands")
        self.append(revisions.reopen(standing, standing, F.lit(at).cast("timestamp")), "rejections", REJECTIONS)


def revisions_event(rows: DataFrame) -> DataFrame:
    return rows.withColumn("event_id", F.concat_ws("/", "evidence_id", F.col("event_at").cast("string"))).withColumn("replacement", F.lit(None).cast("string"))
