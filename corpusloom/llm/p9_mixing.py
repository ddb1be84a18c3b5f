"""Problem 9: a mix of sources with target shares of tokens and capped repetition.

Method: Pareto order sampling. The mix is as large as the caps allow with every source that has documents at its target
share. A source that needs r times its tokens gives floor(r) certain copies of every document; the rest is an
unequal-probability sample: documents are ranked by the odds of a fixed random number over the odds of their inclusion
(in proportion to their size), and the first ones that fill the remaining tokens are taken. The cut is found from token sums
of BUCKETS rank buckets for each source and one more pass inside the bucket that is cut, so no source is ordered in one task.

Defined results: source names are compared without case and outer blanks; documents with null id, null source or no tokens
are not in the mix; repeated doc_ids count once; sources without target are left out and reported without a target; targets
without documents are reported with nothing reached and the other targets keep their proportions; the first target row wins.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.operators.keys import measured_broadcast
from corpusloom.session import cut

BUCKETS = 4096
SEED = 17
TOKENIZER = "byte_bpe_50k.tiktoken"
BATCH = 512


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(TOKENIZER)


def encoder(path: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    pattern = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
    return tiktoken.Encoding("corpusloom", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def token_counts(documents: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, source, tokens): whole texts in tokens of the tokenizer at path; 0 for null texts."""
    at = path or tokenizer_path()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(at)
        for b in batches:
            n = [len(enc.encode_ordinary(t.encode("utf-8", "replace").decode())) if t else 0 for t in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(n, pa.int64())], ["doc_id", "source", "tokens"])

    few = documents.filter("doc_id is not null").select("doc_id", F.nullif(F.trim(F.lower("source")), F.lit("")).alias("source"), "text")
    return few.mapInArrow(count, "doc_id bigint, source string, tokens bigint")


class Mix:
    def __init__(self, documents: DataFrame, targets: DataFrame, path: str | None = None, seed: int = SEED, total: int | None = None) -> None:
        counted = token_counts(documents, path)
        self.sizes = cut(counted.groupBy("doc_id").agg(F.max(F.struct("tokens", "source")).alias("m")).select("doc_id", "m.source", "m.tokens"))
        have = self.sizes.filter("source is not null and tokens > 0").groupBy("source").agg(F.sum("tokens").alias("have"), F.count(F.lit(1)).alias("documents"))
        name = F.nullif(F.trim(F.lower("source")), F.lit(""))
        want = targets.select(name.alias("source"), "target_share", "max_repeats").filter("source is not null")
        want = want.groupBy("source").agg(F.max(F.struct("target_share", "max_repeats")).alias("m")).select("source", "m.target_share", F.greatest(F.coalesce("m.max_repeats", F.lit(0)), F.lit(0)).alias("max_repeats"))
        plan = want.join(have, "source", "full")
        usable = (F.col("have") > 0) & (F.col("target_share") > 0) & (F.col("max_repeats") > 0)
        room = F.when(usable, F.col("have") * F.col("max_repeats") / F.col("target_share"))
        plan = plan.withColumn("usable", F.coalesce(usable, F.lit(False))).withColumn("room", room)
        room_ = plan.agg(F.min("room")).first()[0] if total is None else float(total)
        size = F.lit(float(room_ or 0.0))
        ratio = F.when(F.col("usable"), F.least(size * F.col("target_share") / F.col("have"), F.col("max_repeats").cast("double"))).otherwise(0.0)
        plan = plan.withColumn("ratio", ratio)
        whole = F.floor(F.col("ratio") + 1e-9)
        rest = F.greatest(F.lit(0.0), F.col("ratio") - whole) * F.col("have")
        #: one row per source: what it has, its target, whole copies and the tokens still to sample
        self.plan = cut(plan.select("source", "target_share", "max_repeats", "have", "documents", "ratio", whole.cast("bigint").alias("whole"), F.floor(rest + 0.5).cast("bigint").alias("rest")))
        self.seed = seed

    def chosen(self) -> DataFrame:
        """(doc_id, source, tokens, copies) of every document that is in the mix."""
        docs = self.sizes.filter("source is not null and tokens > 0").join(measured_broadcast(self.plan), "source").filter("ratio > 0")
        u = (F.pmod(F.xxhash64("doc_id", F.lit(self.seed)), F.lit((1 << 52) - 1)) + 0.5) / float(1 << 52)
        chance = F.least(F.lit(0.999), F.greatest(F.lit(1e-9), (F.col("rest") / F.col("have")) * F.col("tokens") * F.col("documents") / F.col("have")))
        odds = (u / (1 - u)) / (chance / (1 - chance))
        docs = docs.withColumn("rank", odds / (1 + odds)).withColumn("bucket", F.least(F.floor(F.col("rank") * BUCKETS), F.lit(BUCKETS - 1)).cast("int"))
        sums = docs.filter("rest > 0").groupBy("source", "bucket", "rest").agg(F.sum("tokens").alias("t"))
        w = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)  # at most BUCKETS rows a source
        before = sums.withColumn("before", F.coalesce(F.sum("t").over(w), F.lit(0)))
        edge = cut(before.filter("before < rest and before + t > rest").select("source", F.col("bucket").alias("edge"), "before"))
        full = cut(before.filter("before + t <= rest").groupBy("source").agg(F.max("bucket").alias("last")))
        docs = docs.join(measured_broadcast(edge), "source", "left").join(measured_broadcast(full), "source", "left")
        inside = docs.filter(F.col("bucket") == F.col("edge"))
        order = Window.partitionBy("source").orderBy("rank", "doc_id").rowsBetween(Window.unboundedPreceding, 0)  # one bucket of BUCKETS
        # up to the document whose addition comes closest to the tokens wanted
        taken = inside.withColumn("upto", F.col("before") + F.sum("tokens").over(order)).filter(F.col("upto") - F.col("tokens") / 2 <= F.col("rest"))
        out = taken.withColumn("extra", F.lit(1)).select("doc_id", "source", "tokens", "whole", "extra")
        outer = docs.filter(F.col("edge").isNull() | (F.col("bucket") != F.col("edge")))
        extra = F.coalesce((F.col("bucket") <= F.col("last")).cast("int"), F.lit(0))
        out = out.unionByName(outer.withColumn("extra", extra).select("doc_id", "source", "tokens", "whole", "extra"))
        rest = inside.withColumn("upto", F.col("before") + F.sum("tokens").over(order)).filter(F.col("upto") - F.col("tokens") / 2 > F.col("rest")).withColumn("extra", F.lit(0))
        out = out.unionByName(rest.select("doc_id", "source", "tokens", "whole", "extra"))
        return out.select("doc_id", "source", "tokens", (F.col("whole") + F.col("extra")).cast("int").alias("copies")).filter("copies > 0")

    def shares(self) -> DataFrame:
        """(source, target_share, max_repeats, documents, have, tokens, repeats, actual_share): what was really reached."""
        got = self.chosen().groupBy("source").agg(F.sum(F.col("tokens") * F.col("copies")).alias("tokens"), F.max("copies").alias("repeats"))
        got = cut(got)  # one row per source
        all_ = F.lit(int(got.agg(F.sum("tokens")).first()[0] or 0))
        out = self.plan.join(got, "source", "left")
        zero = F.lit(0)
        return out.select("source", "target_share", "max_repeats", F.coalesce("documents", zero).alias("documents"), F.coalesce("have", zero).alias("have"), F.coalesce("tokens", zero).alias("tokens"), F.coalesce("repeats", zero).alias("repeats"), F.coalesce(F.try_divide(F.col("tokens"), all_), F.lit(0.0)).alias("actual_share"))


def mix(documents: DataFrame, targets: DataFrame) -> DataFrame:
    return Mix(documents, targets).chosen()


def shares(documents: DataFrame, targets: DataFrame) -> DataFrame:
    return Mix(documents, targets).shares()
