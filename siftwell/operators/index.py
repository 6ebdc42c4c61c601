"""The inverted index as tables: postings, term statistics, document lengths, corpus statistics.

Postings are long rows (field, term, doc_id, tf, size); size is the field's length in the document, so that a search
needs no other table to score. Source tokens count as title terms but not in the title's length."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass, replace

from pyspark import StorageLevel
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siftwell.functions import segment
from siftwell.functions.text import once, tokens
from siftwell.schema import with_defaults

Analyzer = Callable[[Column], Column]
#: Whether a term is wanted.
Keep = Callable[[Column], Column]


def analyzer(stop_words: Iterable[str] = (), segmented: bool | None = None) -> Analyzer:
    """segmented: whether texts with Han characters go through the segmenter; by default where one is installed."""
    stop = tuple(stop_words)
    cut = segment.segmented_tokens if (segment.installed() if segmented is None else segmented) else tokens
    return lambda text: cut(text, stop)


def analyzed(docs: DataFrame, analyze: Analyzer) -> DataFrame:
    """doc_id, title_tokens, source_tokens, content_tokens."""
    docs = with_defaults(docs)
    return docs.select("doc_id", *(analyze(F.col(c)).alias(n) for c, n in (("title", "title_tokens"), ("source_site", "source_tokens"), ("content", "content_tokens"))))


def counts(tokens: Column) -> Column:
    """Each token of an array once, with its number: array of term, tf. By sorting, within the row."""

    def runs(s: Column) -> Column:
        begins = F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda i: (i == 0) | (F.get(s, i) != F.get(s, i - 1)))
        run = lambda b: F.transform(b, lambda p, k: F.struct(F.get(s, p).alias("term"), (F.coalesce(F.get(b, k + 1), F.size(s)) - p).alias("tf")))
        return once(begins, run)

    return F.when(F.size(tokens) > 0, once(F.sort_array(tokens), runs))


def counted(rows: DataFrame, keep: Keep | None = None) -> DataFrame:
    """doc_id, title_len, content_len, title, content: what an index is made of, with the counts of each field's terms."""
    kept = lambda c: F.filter(c, keep) if keep else c
    title, content = F.concat(kept(F.col("title_tokens")), kept(F.col("source_tokens"))), kept(F.col("content_tokens"))
    return lengths_of(rows, counts(title).alias("title"), counts(content).alias("content"))


def postings_of(rows: DataFrame, keep: Keep | None = None) -> DataFrame:
    """field, term, doc_id, tf, size. With keep, only of the terms that it says yes to: others are dropped first.

    Terms are counted within a row, so nothing is shuffled but the ids, and the postings of ids that stand in several rows."""
    return postings_in(counted(rows, keep))


def postings_in(counted: DataFrame) -> DataFrame:
    """The postings of counted()."""
    one, again = by_repetition(counted)
    return dealt(one).union(summed(dealt(again)))


def dealt(counted: DataFrame) -> DataFrame:
    fields = F.array(*(F.struct(F.lit(f).alias("field"), F.col(f).alias("terms"), F.col(f + "_len").alias("size")) for f in ("title", "content")))
    rows = counted.select("doc_id", F.explode(fields).alias("f")).select("doc_id", "f.field", "f.size", F.explode("f.terms").alias("t"))
    return rows.select("field", "t.term", "doc_id", "t.tf", "size")


def summed(postings: DataFrame) -> DataFrame:
    return postings.groupBy("field", "term", "doc_id").agg(F.sum("tf").cast("int").alias("tf"), F.max("size").alias("size")).select("field", "term", "doc_id", "tf", "size")


def hits_of(index: Index, keep: Keep) -> DataFrame:
    """doc_id, hits (array of field, term, tf, size): each document's postings of the terms that keep says yes to. Of an index
    that has just been built, within its rows."""
    entry = F.struct("field", "term", "tf", "size")
    gathered = lambda postings: postings.groupBy("doc_id").agg(F.collect_list(entry).alias("hits"))
    if index.rows is None:
        return gathered(index.of(keep).postings)
    one, again = by_repetition(counted(index.rows, keep))
    of_field = lambda f: F.transform(F.col(f), lambda x: F.struct(F.lit(f).alias("field"), x["term"].alias("term"), x["tf"].alias("tf"), F.col(f + "_len").alias("size")))
    return one.select("doc_id", F.flatten(F.filter(F.array(of_field("title"), of_field("content")), lambda f: f.isNotNull())).alias("hits")).union(gathered(summed(dealt(again))))


def by_repetition(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows whose doc_id no other row has, and the others. Only ids are shuffled; those that repeat go to all executors."""
    repeated = F.broadcast(rows.groupBy(F.col("doc_id").alias("_id")).agg(F.count("*").alias("_n")).where("_n > 1").select("_id"))
    same = rows["doc_id"].eqNullSafe(repeated["_id"])
    return rows.join(repeated, same, "left_anti"), rows.join(repeated, same, "left_semi")


def lengths_of(rows: DataFrame, *more: Column) -> DataFrame:
    return rows.select("doc_id", F.size("title_tokens").alias("title_len"), F.size("content_tokens").alias("content_len"), *more)


def sums_of(lengths: DataFrame) -> DataFrame:
    """One row: n_docs, title_sum, content_sum."""
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    return lengths.agg(F.count("*").alias("n_docs"), total("title_len").alias("title_sum"), total("content_len").alias("content_sum"))


def averages_of(sums: DataFrame) -> DataFrame:
    """One row for rows of sums: n_docs, avg_title_len, avg_content_len (0 for an empty corpus), and the sums."""
    sums = sums.agg(*(F.sum(c).alias(c) for c in ("n_docs", "title_sum", "content_sum")))
    mean = lambda c: F.when(F.col("n_docs") > 0, F.col(c).cast("double") / F.col("n_docs")).otherwise(F.lit(0.0))
    return sums.select("n_docs", mean("title_sum").alias("avg_title_len"), mean("content_sum").alias("avg_content_len"), "title_sum", "content_sum")


def statistics_of(lengths: DataFrame) -> DataFrame:
    return averages_of(sums_of(lengths))


def term_statistics(postings: DataFrame) -> DataFrame:
    return postings.groupBy("field", "term").agg(F.count("*").alias("df"))


@dataclass
class Index:
    docs: DataFrame
    postings: DataFrame
    term_stats: DataFrame
    doc_len: DataFrame
    corpus_stats: DataFrame
    #: Analysed documents, where the index has just been built from them.
    rows: DataFrame | None = None

    TABLES = ("docs", "postings", "term_stats", "doc_len", "corpus_stats")

    def save(self, path: str) -> None:
        """Parquet under path, as batch 0; see append()."""
        write_batch(self, path, 0)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Index:
        """What the last batch that was finished left; later ones that are being written aren't seen."""
        try:
            version = latest(spark, path)
            batches = (spark.read.parquet(f"{path}/{t}").where(F.col("batch") <= version).drop("batch") for t in ("docs", "postings", "doc_len"))
            docs, postings, doc_len = batches
            return cls(docs, postings, spark.read.parquet(f"{path}/term_stats/{version}"), doc_len, spark.read.parquet(f"{path}/corpus_stats/{version}"))
        except (AnalysisException, TypeError) as missing:
            raise FileNotFoundError(f"there is no index at {path}: build it first") from missing

    def vocabulary(self, field: str | None = None) -> DataFrame:
        rows = self.term_stats.where(F.col("field") == field) if field else self.term_stats
        return rows.select("term").distinct()

    def statistics(self) -> DataFrame:
        """doc_count, term_count (of contents), title_term_count."""
        of = lambda f: F.count_if(F.col("field") == f)
        terms = self.term_stats.agg(of("content").alias("term_count"), of("title").alias("title_term_count"))
        return self.corpus_stats.select(F.col("n_docs").alias("doc_count")).join(terms)  # one row each

    def lookup(self, terms: Iterable[str]) -> DataFrame:
        return self.of(one_of(terms)).postings

    def of(self, keep: Keep) -> Index:
        """The same index with the terms only that keep says yes to. Where it has just been built, the others aren't counted."""
        if self.rows is None:
            return replace(self, postings=self.postings.where(keep(F.col("term"))), term_stats=self.term_stats.where(keep(F.col("term"))))
        postings = postings_of(self.rows, keep)
        return replace(self, postings=postings, term_stats=term_statistics(postings), rows=None)


def one_of(terms: Iterable[str]) -> Keep:
    wanted = list(terms)
    return lambda t: t.isin(wanted)


def build(docs: DataFrame, stop_words: Iterable[str] = (), analyze: Analyzer | None = None) -> Index:
    rows = analyzed(docs, analyze or analyzer(stop_words))
    postings, lengths = postings_of(rows), lengths_of(rows)
    return Index(with_defaults(docs), postings, term_statistics(postings), lengths, statistics_of(lengths), rows)


def latest(spark: SparkSession, path: str, before: int | None = None) -> int | None:
    """The number of the last finished batch (before a given one)."""
    done = spark.read.parquet(f"{path}/done")
    return done.where(F.col("batch") < before if before is not None else F.lit(True)).agg(F.max("batch")).first()[0]


def write_batch(batch: Index, path: str, number: int) -> None:
    """A folder for each batch. Postings are clustered by field and term, so that a term's lookup reads few row groups.

    The statistics of a batch are those of the batch before and its own postings' added up; nothing older is counted
    again. They get a folder of their own, and a mark at the end makes them the current ones, so searches see one state
    or the other. Of documents that have just been analysed the counts are kept until they are written, so that texts are
    cut into tokens once."""
    spark, postings, lengths, kept = batch.docs.sparkSession, batch.postings, batch.doc_len, None
    if batch.rows is not None:
        kept = counted(batch.rows).persist(StorageLevel.DISK_ONLY)
        postings, lengths = postings_in(kept), kept.select(*lengths.columns)
    clustered = postings.repartitionByRange("field", "term").sortWithinPartitions("field", "term", "doc_id")
    for name, rows in (("docs", batch.docs), ("postings", clustered), ("doc_len", lengths)):
        rows.write.mode("overwrite").parquet(f"{path}/{name}/batch={number}")
    if kept is not None:
        kept.unpersist()
    own = term_statistics(spark.read.parquet(f"{path}/postings/batch={number}"))
    lengths = sums_of(spark.read.parquet(f"{path}/doc_len/batch={number}"))
    before = latest(spark, path, number) if number else None
    if before is not None:
        own = own.union(spark.read.parquet(f"{path}/term_stats/{before}")).groupBy("field", "term").agg(F.sum("df").alias("df"))
        lengths = lengths.union(spark.read.parquet(f"{path}/corpus_stats/{before}").select("n_docs", "title_sum", "content_sum"))
    own.repartitionByRange("field", "term").sortWithinPartitions("field", "term").write.mode("overwrite").parquet(f"{path}/term_stats/{number}")
    averages_of(lengths).write.mode("overwrite").parquet(f"{path}/corpus_stats/{number}")
    spark.range(1).select(F.lit(number).alias("batch")).write.mode("overwrite").parquet(f"{path}/done/part={number}")


def append(spark: SparkSession, path: str, docs: DataFrame, batch: int, stop_words: Iterable[str] = (), analyze: Analyzer | None = None) -> None:
    """Add documents with new ids to a saved index, as a batch with a number from 1, in this order. A batch that comes
    again replaces itself, so a job that was broken off can be run once more."""
    write_batch(build(docs, stop_words, analyze), path, batch)


def keywords(docs: DataFrame, column: str = "content", k: int = 10, analyze: Analyzer | None = None) -> DataFrame:
    """doc_id, rank, term, tf: the k most frequent terms of each text, ties by first occurrence."""
    tokens = (analyze or analyzer())(F.col(column))
    once_each, repeated = by_repetition(docs.select("doc_id", F.col(column)))
    best = once_each.select("doc_id", F.posexplode(F.slice(frequent(tokens), 1, k)).alias("at", "t"))
    best = best.select("doc_id", (F.col("at") + 1).alias("rank"), "t.term", "t.tf")
    # the texts of an id that several rows have count together
    found = repeated.select("doc_id", F.posexplode(tokens).alias("at", "term"))
    counted = found.groupBy("doc_id", "term").agg(F.count("*").alias("tf"), F.min("at").alias("first_at"))
    rank = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("tf"), "first_at"))
    return best.union(counted.withColumn("rank", rank).where(F.col("rank") <= k).select("doc_id", "rank", "term", "tf"))


def frequent(tokens: Column) -> Column:
    """The tokens of an array by frequency, then first occurrence: array of term, tf. Within the row."""

    def runs(s: Column) -> Column:
        begins = F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda i: (i == 0) | (F.get(s, i)["term"] != F.get(s, i - 1)["term"]))
        size = lambda b, p, k: (F.coalesce(F.get(b, k + 1), F.size(s)) - p).cast("long")
        run = lambda b: F.transform(b, lambda p, k: F.struct((-size(b, p, k)).alias("less"), F.get(s, p)["at"].alias("at"), F.get(s, p)["term"].alias("term")))
        return F.transform(F.sort_array(once(begins, run)), lambda r: F.struct(r["term"].alias("term"), (-r["less"]).alias("tf")))

    placed = F.transform(tokens, lambda t, i: F.struct(t.alias("term"), i.alias("at")))
    return once(F.sort_array(placed), lambda s: F.when(F.size(s) > 0, runs(s)))
