"""Sources, normalization and text functions, index round trip, sessions; with their SQL."""

from __future__ import annotations

import json
import zipfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.functions import text as tx
from textloom.operators import search
from textloom.plans.search_sql import CORPUS, GRAMS
from textloom.session import file_system, scratch, table
from textloom.sources import files, index_store
from textloom.streaming import session


def _text_files(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "text_files").where(F.col("content").isNotNull())


def _member(file_id: int) -> str:
    return f"d{file_id % 7}/{file_id:08d}.{'TXT' if file_id % 2 else 'txt'}"


def _written(spark: SparkSession, folder: str) -> str:
    """The text files written out as files, one per file_id, by the executors, into the shared folder."""
    base = scratch(spark)

    def write(rows) -> None:
        fs, root = file_system(base)
        for r in rows:
            path = f"{root}/{_member(r['file_id'])}"
            fs.create_dir(path.rsplit("/", 1)[0], recursive=True)
            with fs.open_output_stream(path) as out:
                out.write(r["content"].encode())

    _text_files(spark, folder).select("file_id", "content").foreachPartition(write)
    return base


def _scanned(rows: DataFrame) -> DataFrame:
    return rows.select("source_path", F.md5(F.col("content").cast("binary")).alias("content_md5"), "status")


def scan_text_dir(spark, folder):
    return _scanned(files.load(spark, _written(spark, folder)))


def scan_text_file(spark, folder):
    """The first file alone."""
    base = _written(spark, folder)
    first = table(spark, folder, "text_files").where(F.col("content").isNotNull()).agg(F.min("file_id").alias("i")).first()["i"]
    return _scanned(files.load(spark, f"{base}/{_member(first)}"))


def scan_zip(spark, folder):
    """The text files as members of ZIP archives, one archive per partition, written by the executors."""
    base = scratch(spark)

    def write(index: int, rows):
        fs, root = file_system(base)
        fs.create_dir(root, recursive=True)
        with fs.open_output_stream(f"{root}/{index:05d}.zip") as raw, zipfile.ZipFile(raw, "w", zipfile.ZIP_DEFLATED) as out:
            for r in rows:
                out.writestr(f"f/{r['file_id']:08d}.txt", r["content"])
            out.writestr("skipped.bin", b"\0")
        yield index

    _text_files(spark, folder).select("file_id", "content").rdd.mapPartitionsWithIndex(write).count()
    return _scanned(files.scan_zip(spark, f"{base}/*.zip"))


def _as_files(spark, folder):
    """The table's files in the loader's form: some were loaded twice under one path and content."""
    rows = table(spark, folder, "text_files")
    return rows.select(
        F.concat_ws("::", "source_text", F.coalesce(F.md5(F.col("content").cast("binary")), F.lit("-"))).alias("file_key"), F.col("source_text").alias("source_path"),
        F.regexp_replace(F.regexp_replace("content", "^\ufeff", ""), "\r\n?", "\n").alias("content"), F.when(F.col("content").isNull(), files.INVALID).otherwise(files.LOADED).alias("status"),
    )


def load_dedup(spark, folder):
    return files.drop_loaded(_as_files(spark, folder)).groupBy("source_path", "status").agg(F.count(F.lit(1)).alias("n_files"))


def load_stats(spark, folder):
    """A second load of everything after one load of the even-length paths."""
    rows = _as_files(spark, folder)
    return files.load_stats(files.drop_loaded(rows, rows.where(F.length("source_path") % 2 == 0)))


def normalize(spark, folder):
    return table(spark, folder, "prepared_sentences").select("sentence_id", tx.normalize(F.col("original_text")).alias("normalized"))


def word_positions(spark, folder):
    rows = table(spark, folder, "prepared_sentences").where(F.col("normalized_text").isNotNull())
    return rows.select("sentence_id", F.inline(tx.word_positions(F.col("normalized_text"))))


def prepare_sentences(spark, folder):
    loaded = files.drop_loaded(_as_files(spark, folder)).where(F.col("status") == files.LOADED)
    prepared = files.prepare_sentences(loaded.groupBy("source_path").agg(F.min("content").alias("content")))
    return prepared.select("sentence_id", "source_path", "line_no", "original_text", "normalized_text", F.size("word_positions").alias("n_words"))


def qgrams(spark, folder):
    """Trigrams of the query workload with their offsets."""
    return table(spark, folder, "queries").select("query_id", F.inline(tx.grams(F.col("normalized_query"), 3)))


def length_bucket(spark, folder):
    rows = table(spark, folder, "queries")
    return rows.groupBy(tx.length_bucket(F.length("normalized_query")).alias("length_bucket")).agg(F.count(F.lit(1)).alias("n_queries"))


def result_bucket(spark, folder):
    counts = table(spark, folder, "completions").where(F.col("query_id").isNotNull()).groupBy("query_id").agg(F.count(F.lit(1)).alias("n"))
    return counts.groupBy(tx.result_bucket(F.col("n")).alias("result_bucket")).agg(F.count(F.lit(1)).alias("n_queries"))


def _words(spark, folder):
    return search.words(table(spark, folder, "prepared_sentences").select("sentence_id", F.col("normalized_text").alias("n"))).select("word").distinct()


def repeated_words(spark, folder):
    """Words with a doubled character, or a piece of two or more characters that comes again."""
    return _words(spark, folder).where(tx.has_repeats(F.col("word")))


def mutations(spark, folder):
    """The three one-edit mutations of every word of six or more characters, in the middle."""
    rows = _words(spark, folder).where(F.length("word") >= 6)
    return rows.select("word", F.inline(tx.mutations(F.col("word"), F.floor(F.length("word") / 2).cast("int"))))


def index_roundtrip(spark, folder):
    """The index written to the shared folder, read back, and summed up per gram size."""
    path = scratch(spark)
    index_store.save_index(table(spark, folder, "prepared_sentences").select("sentence_id", "original_text", "normalized_text", "source_path", "line_no"), path, [2, 3], "test")
    index = index_store.load_index(spark, path, [2, 3], "test")
    per = index["postings"].groupBy("gram_size").agg(F.count(F.lit(1)).alias("postings"), F.countDistinct("gram").alias("grams"))
    return per.join(index["frequencies"].groupBy("gram_size").agg(F.max("frequency").alias("max_frequency")), "gram_size")


def load_queries(spark, folder):
    """The golden workload written as one JSON document and read back."""
    path = scratch(spark)
    rows = [r.asDict(recursive=True) for r in table(spark, folder, "saved_queries").collect()]  # 48 rows, fixed
    fs, root = file_system(path)
    fs.create_dir(root, recursive=True)
    with fs.open_output_stream(f"{root}/queries.json") as out:
        out.write(json.dumps({"queries": rows}).encode())
    return files.load_queries(spark, f"{path}/queries.json").select("query_id", "normalized_query", "length_bucket", F.concat_ws("|", "categories").alias("categories"))


def _lines(df: DataFrame) -> DataFrame:
    return df.select(F.col("user_id").cast("string").alias("session"), F.col("event_id").alias("turn"), F.when(F.col("event_type") == "purchase", session.RESET).when(F.col("event_type") == "error", " ").otherwise(F.col("event_type")).alias("line"))


def session_prefix(spark, folder):
    """Users as sessions: an event's type is a typed line, a purchase starts anew, an error is a blank line."""
    return session.session_prefixes(_lines(table(spark, folder, "events"))).withColumn("prefix", F.md5(F.col("prefix").cast("binary")))


def session_stream(spark, folder):
    """The same as a stream over the events file, run to its end."""
    schema = table(spark, folder, "events").schema
    source = scratch(spark)
    table(spark, folder, "events").write.parquet(source)
    out = scratch(spark)
    stream = session.stream_prefixes(_lines(spark.readStream.schema(schema).parquet(source)))
    query = stream.writeStream.format("parquet").option("path", f"{out}/rows").option("checkpointLocation", f"{out}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema("session string, turn long, prefix string").parquet(f"{out}/rows").withColumn("prefix", F.md5(F.col("prefix").cast("binary")))


QUERIES = {
    f.__name__: f
    for f in (
        scan_text_dir, scan_text_file, scan_zip, load_dedup, load_stats, normalize, word_positions, prepare_sentences, qgrams, length_bucket, result_bucket, repeated_words, mutations, index_roundtrip, load_queries,
        session_prefix, session_stream,
    )
}

# The same patterns as in functions/text.py; the engine takes Java's classes as they are.
_PLAIN = r"regexp_replace(regexp_replace(content, '^\x{feff}', ''), '\r\n?', chr(10), 'g')"
_NORMAL = f"trim(regexp_replace(regexp_replace(lower(original_text), '{tx.PUNCTUATION}', '', 'g'), '{tx.BLANK}+', ' ', 'g'))"
_FILES = "select source_text, content from text_files"
_PATH = "printf('d%d/%08d', file_id % 7, file_id) || case when file_id % 2 = 1 then '.TXT' else '.txt' end"
_SESSION = """
with l as (select cast(user_id as varchar) as session, event_id as turn, event_type as line from events where event_type <> 'error'),
g as (select *, sum(case when line = 'purchase' then 1 else 0 end) over (partition by session order by turn rows unbounded preceding) as part from l)
select session, turn, md5(string_agg(line, ' ') over (partition by session, part order by turn rows unbounded preceding)) as prefix from g where line <> 'purchase'
"""


def _ladder(value: str, ladder: tuple) -> str:
    steps = " ".join(f"when {value} <= {top} then '{name}'" for top, name in ladder[:-1])
    return f"case {steps} when {value} is not null then '{ladder[-1][1]}' end"


SQL = {
    "scan_text_dir": f"select {_PATH} as source_path, md5({_PLAIN}) as content_md5, 'loaded' as status from text_files where content is not null",
    "scan_text_file": f"select regexp_extract({_PATH}, '[^/]+$') as source_path, md5({_PLAIN}) as content_md5, 'loaded' as status from text_files where file_id = (select min(file_id) from text_files where content is not null)",
    "scan_zip": r"select printf('f/%08d.txt', file_id) as source_path, md5(regexp_replace(content, '^\x{feff}', '')) as content_md5, 'loaded' as status from text_files where content is not null",
    "load_dedup": f"""with k as (select source_text, content is null as bad, count(*) as n from ({_FILES}) f group by source_text, content)
select source_text as source_path, 'invalid' as status, cast(sum(n) as bigint) as n_files from k where bad group by 1
union all select source_text, 'loaded', count(*) from k where not bad group by 1
union all select source_text, 'duplicate', cast(sum(n - 1) as bigint) from k where not bad group by 1 having sum(n - 1) > 0""",
    "load_stats": f"""with k as (select length(source_text) % 2 = 0 as known, content is null as bad, count(*) as n from ({_FILES}) f group by source_text, content)
select cast(coalesce(sum(case when not bad and not known then 1 else 0 end), 0) as bigint) as loaded_files, cast(coalesce(sum(case when bad then 0 when known then n else n - 1 end), 0) as bigint) as skipped_duplicates,
cast(coalesce(sum(case when bad then n else 0 end), 0) as bigint) as skipped_invalid from k""",
    "normalize": f"select sentence_id, {_NORMAL} as normalized from prepared_sentences",
    "word_positions": """with w as (select sentence_id, unnest(string_split(normalized_text, ' ')) as word, generate_subscripts(string_split(normalized_text, ' '), 1) as i from prepared_sentences where normalized_text is not null),
p as (select sentence_id, word, sum(length(word) + 1) over (partition by sentence_id order by i rows unbounded preceding) - 1 as e from w)
select sentence_id, word, cast(e - length(word) as int) as start_pos, cast(e as int) as end_pos from p where word <> ''""",
    "prepare_sentences": f"""with f as (select source_text, min({_PLAIN}) as content from text_files where content is not null group by source_text),
l as (select source_text as source_path, unnest(string_split(content, chr(10))) as original_text, generate_subscripts(string_split(content, chr(10)), 1) as line_no from f),
n as (select source_path, cast(line_no as int) as line_no, original_text, {_NORMAL} as normalized_text from l)
select row_number() over (order by source_path, line_no) - 1 as sentence_id, source_path, line_no, original_text, normalized_text, cast(len(string_split(normalized_text, ' ')) as int) as n_words from n where normalized_text <> ''""",
    "qgrams": "select query_id, substring(normalized_query, i + 1, 3) as gram, cast(i as int) as position from queries, unnest(generate_series(0, length(normalized_query) - 3)) u(i) where length(normalized_query) >= 3",
    "length_bucket": f"select {_ladder('length(normalized_query)', tx.LENGTH_BUCKETS)} as length_bucket, count(*) as n_queries from queries group by 1",
    "result_bucket": f"select {_ladder('n', tx.RESULT_BUCKETS)} as result_bucket, count(*) as n_queries from (select query_id, count(*) as n from completions where query_id is not null group by 1) c group by 1",
    "repeated_words": """with v as (select distinct unnest(string_split(normalized_text, ' ')) as word from prepared_sentences),
c as (select word, i, substring(word, i, 1) as one, substring(word, i, 2) as two from v, unnest(generate_series(1, length(word))) u(i))
select distinct a.word from c a join c b on a.word = b.word and (a.one = b.one and b.i = a.i + 1 or length(a.two) = 2 and a.two = b.two and b.i >= a.i + 2)""",
    "mutations": """with v as (select distinct unnest(string_split(normalized_text, ' ')) as word from prepared_sentences), w as (select word, length(word) // 2 as i from v where length(word) >= 6)
select word, 'replacement' as mutation, left(word, i) || case when substring(word, i + 1, 1) = 'x' then 'z' else 'x' end || substring(word, i + 2) as text from w
union all select word, 'missing_character', left(word, i) || substring(word, i + 2) from w
union all select word, 'extra_character', left(word, i) || 'x' || substring(word, i + 1) from w""",
    "index_roundtrip": f"""with {CORPUS}, {GRAMS}, f as (select gram_size, gram, count(*) as c from g where gram_size > 1 group by all)
select gram_size, cast(sum(c) as bigint) as postings, count(*) as grams, max(c) as max_frequency from f group by gram_size""",
    "load_queries": "select query_id, normalized_query, length_bucket, array_to_string(categories, '|') as categories from saved_queries",
    "session_prefix": _SESSION,
    "session_stream": _SESSION,
}
