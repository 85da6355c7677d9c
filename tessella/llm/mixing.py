"""Sources mixed to target weights, with capped repetition."""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessella.session import materialize

VOCABULARY = os.path.join(os.environ.get("TESSELLA_TOKENIZERS", "/opt/tokenizers"), "byte_bpe_multi_50k.tiktoken")
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"""
_encoders: dict = {}


def encoder(ranks: bytes) -> object:
    """The tokenizer of a rank file's content, made once per process."""
    key = hash(ranks)
    if key not in _encoders:
        import tiktoken

        pairs = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines()) if a}
        _encoders[key] = tiktoken.Encoding("mix", pat_str=PATTERN, mergeable_ranks=pairs, special_tokens={})
    return _encoders[key]


def token_counts(corpus: DataFrame, *, doc_id: str = "doc_id", source: str = "source", text: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, source, tokens); null texts have 0 tokens. ``vocabulary`` is read by the driver, which sends it (about 1 MB) to the executors."""
    with open(vocabulary, "rb") as file:
        ranks = corpus.sparkSession.sparkContext.broadcast(file.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(ranks.value).encode_ordinary
        for batch in batches:
            sizes = [len(encode(t)) if t else 0 for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sizes, pa.int64())], names=["doc_id", "source", "tokens"])

    kind = corpus.schema[doc_id].dataType.simpleString()
    return corpus.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), F.col(text).alias("text")).mapInArrow(run, f"doc_id {kind}, source string, tokens bigint")


def rates(counts: DataFrame, targets: DataFrame, total_tokens: float | None = None) -> DataFrame:
    """Per target source: tokens held, target share, and how often each of its documents is used on average.

    Shares are taken among the sources that hold tokens. ``total_tokens`` is the size of the
    mix; by default the largest at which every such source reaches its share within its cap.
    A larger size leaves capped sources short, which the report then shows.
    Targets without tokens get rate 0. Targets must be distinct; null, zero or negative shares get rate 0,
    a null cap means 1.
    """
    held = counts.where("source is not null").groupBy("source").agg(F.sum("tokens").alias("tokens"), F.count("*").alias("documents"))
    goal = targets.where("source is not null").groupBy("source").agg(F.max("target_share").alias("share"), F.max(F.coalesce("max_repeats", F.lit(1))).alias("cap"))
    rows = goal.join(held, "source", "left").fillna(0, ["tokens", "documents"]).collect()  # a row per target
    usable = [r for r in rows if r.tokens > 0 and r.cap > 0 and (r.share or 0) > 0]
    whole = sum(r.share for r in usable)
    size = min((r.cap * r.tokens * whole / r.share for r in usable), default=0.0) if total_tokens is None else total_tokens
    rate = {r.source: round(min(size * r.share / whole / r.tokens, r.cap), 9) for r in usable}
    out = sorted((r.source, r.share, r.cap, r.tokens, r.documents, float(rate.get(r.source, 0.0))) for r in rows)
    return counts.sparkSession.createDataFrame(out, "source string, target_share double, max_repeats int, tokens bigint, documents bigint, rate double")


def draw(corpus: DataFrame, targets: DataFrame, *, total_tokens: float | None = None, seed: int = 7, most_targets: int = 10_000, **options: object) -> tuple[DataFrame, DataFrame]:
    """(copies, rates): documents drawn so that sources reach their target shares.

    copies has doc_id, source, tokens, copy_no: floor(rate) copies of each document and one
    more where a hash of the seed and id falls under the fraction, so a draw can be repeated
    and no document exceeds its cap. Documents of null or untargeted sources are not drawn.
    Token counts are made once and kept in the shared folder.
    """
    names = [r[0] for r in targets.select("source").where("source is not null").distinct().limit(most_targets + 1).collect()]
    if len(names) > most_targets:
        raise ValueError(f"more than {most_targets} targets")
    wanted = corpus.where(F.col(str(options.get("source", "source"))).isin(names))
    counts = materialize(token_counts(wanted, **options), "mix-tokens")
    plan = rates(counts, targets, total_tokens)
    chance = (F.pmod(F.xxhash64(F.col("doc_id").cast("string"), F.lit(seed)), F.lit(1 << 52)) / F.lit(float(1 << 52))).cast("double")
    times = F.floor("rate").cast("int") + (chance < F.col("rate") - F.floor("rate")).cast("int")
    used = counts.join(F.broadcast(plan.select("source", "rate")), "source").withColumn("times", times).where("times > 0")  # at most most_targets rows
    copies = used.select("doc_id", "source", "tokens", F.explode(F.sequence(F.lit(1), "times")).alias("copy_no"))
    return copies, plan


def share_report(copies: DataFrame, plan: DataFrame) -> DataFrame:
    """Per target source: tokens held, rate, copies and tokens drawn, target and actual share."""
    drawn = copies.groupBy("source").agg(F.count("*").alias("copies"), F.sum("tokens").alias("drawn_tokens"))
    out = plan.join(drawn, "source", "left").fillna(0, ["copies", "drawn_tokens"])
    share = F.try_divide(F.col("drawn_tokens"), F.sum("drawn_tokens").over(Window.partitionBy(F.lit(1))))  # a row per target
    return out.select("source", "target_share", "max_repeats", "documents", "tokens", "rate", "copies", "drawn_tokens", share.alias("actual_share"))
