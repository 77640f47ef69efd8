"""The registered queries of this package and the SQL with the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, fim, licenses, linededup, neardup, packing, passages, periods, pieces, quality, tokenfiles, topk, toxicity
from ..storage import materialise, new_path
from .tables import table

Query = Callable[[SparkSession, str], DataFrame]


def op1_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five best inner products of every fiftieth embedding."""
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, 5)


def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the token files of all documents say when they are read back."""
    folder = new_path(spark, "token-files")
    tokenfiles.write(table(spark, sf_dir, "documents"), folder)
    return tokenfiles.read(spark, folder)


def op3_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components of the documents on three-word shingles."""
    return neardup.near_duplicates(table(spark, sf_dir, "documents"), shingle=3, percent=85)


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Probabilities of toxicity and its categories for all documents."""
    documents = table(spark, sf_dir, "documents")
    chain = toxicity.train(documents, table(spark, sf_dir, "labels"))
    scored = toxicity.score(documents, chain)
    names = [F.col("categories").getItem(name).alias(name) for name in chain.names[:-1]]
    return scored.select("doc_id", *names, "toxic_probability", (F.col("toxic_probability") >= 0.5).alias("toxic"))


def op5_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages of the documents that are a licence's text or notice."""
    return licenses.scan(table(spark, sf_dir, "documents"))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents without later occurrences of three-line windows."""
    return linededup.dedup_lines(table(spark, sf_dir, "documents"))


def op7_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of the documents that repeat passages of earlier ones."""
    found = passages.repeats(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "start", "end", "n_words", "paragraphs", "first_doc_id")


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of all documents, learnt without the held-out third of the labels."""
    documents = table(spark, sf_dir, "documents")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))
    field = quality.train(documents, table(spark, sf_dir, "labels").filter(~held_out))
    scored = quality.score(documents, field)
    predicted = (F.col("score") >= 0.5).cast("int").alias("predicted")
    return scored.select("doc_id", held_out.alias("held_out"), "score", predicted)


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of at most 1024 ids."""
    packed = packing.pack(table(spark, sf_dir, "documents"))
    return packed.select(
        "doc_id", "piece", "start", F.col("length").cast("long"), "ids_crc32", "sequence_id", "offset", "round", "bins", "bound"
    )


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overlaps of documents and benchmark items."""
    return decontaminate.overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fill-in-the-middle on all documents: forms, lengths, and digests of output and restored text."""
    stored = materialise(fim.store(table(spark, sf_dir, "documents")), "frames")
    return fim.digests(fim.transform(stored))


def op12_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SentencePiece ids of all documents and the texts they decode to, as digests."""
    # written between the two, so that no task runs a worker for each of them
    encoded = materialise(pieces.encode(table(spark, sf_dir, "documents")), "piece-ids")
    return pieces.decode(encoded).select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("text", 256).alias("decoded_sha256"),
    )


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Periodic runs of words of all documents and what is left when each is cut to one period."""
    found = periods.find(periods.with_planted_runs(table(spark, sf_dir, "documents")))
    ranked = F.transform("runs", lambda run: F.struct(run["length"].alias("length"), (-run["start"]).alias("before"), (-run["period"]).alias("shorter")))
    lines = F.transform("runs", lambda run: F.concat_ws(",", run["start"], run["length"], run["period"]))
    best = found.withColumns({"best": F.array_max(ranked), "lines": F.array_join(F.transform(lines, lambda line: F.concat(line, F.lit("\n"))), "")})
    return best.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        (-F.col("best.before")).alias("start"),
        F.col("best.length").alias("length"),
        (-F.col("best.shorter")).alias("period"),
        F.expr("(1000 * best.length) div -best.shorter").alias("exponent_milli"),
        F.sha2("lines", 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def queries() -> dict[str, Query]:
    return {
        "op1_top_k": op1_top_k,
        "op2_token_files": op2_token_files,
        "op3_minhash": op3_minhash,
        "op4_toxicity": op4_toxicity,
        "op5_licenses": op5_licenses,
        "op6_line_dedup": op6_line_dedup,
        "op7_passages": op7_passages,
        "op8_quality": op8_quality,
        "op9_packing": op9_packing,
        "op10_decontaminate": op10_decontaminate,
        "op11_fill_in_middle": op11_fill_in_middle,
        "op12_sentencepiece": op12_sentencepiece,
        "op13_periodic_runs": op13_periodic_runs,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_top_k": topk.SQL,
        "op6_line_dedup": linededup.SQL.format(documents="documents"),
        "op11_fill_in_middle": fim.SQL,
    }
