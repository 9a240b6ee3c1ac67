"""Quality rules whose thresholds come from mergeable quantile sketches per language and source.

Every text gives counts (n_words, n_symbols, ...) and from them a few measures in whole thousandths.  A sketch is
a map from cells of a measure's values to counts: a value under 128 is its own cell, a larger one's cell keeps its
seven highest bits, so a sketch has at most 64 cells for each doubling and tells values to within 1/64, however large
they are.  Adding two sketches merges them, whatever the order.  Sketches are kept per (language, source), and
merged per language and over all documents, for groups too small to set thresholds of their own.

A document is rejected if a measure lies beyond its group's fences.  These are read from the sketch alone: the 90 %
quantile and FENCE times its distance from the median upwards, the 10 % quantile and FENCE times its distance from
the median downwards; a distance of 0 counts as a thousandth.  Measures of rare things have no lower fence.
Everything is DataFrame expressions.

Duplicate lines and repeated windows are counted but have no fence: most texts hold none, so a quantile of theirs
would reject every text that has one.  The base rule judges repeated windows.

Defined results: a null or empty text has no words and fails the base rule.  Null languages and sources are
groups like any other.  Repeated rows count, and are judged, one by one.  An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._common import WORD, join_small, let, read, stage, window_hashes

SYMBOLS = "#*$%&|<>"
WINDOW, LEAST_WORDS, REPEATED_PERCENT = 8, 20, 30
POINTS = ".,;:!?"
#: Measure: its numerator and denominator, and whether it has a lower fence.
MEASURES = {
    "symbols": ("n_symbols", "n_words", False),
    "stutter": ("n_stutter", "n_words", False),
    "capitals": ("n_capitals", "word_chars", True),
    "points": ("n_points", "n_words", True),
    "word_length": ("word_chars", "n_words", True),
}
FENCE, QUANTILES, LEAST_GROUP, CELL_BITS = 4, (10, 50, 90), 100, 7
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def _repeat_words(word_hashes: Column) -> Column:
    """How many words lie in a window of WINDOW words that the text holds twice or more, by the windows' 64-bit hashes.

    Sorting finds equal ones.
    """
    def covered(h: Column) -> Column:
        ordered = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        twice = let(ordered, lambda s: F.filter(s, lambda x, k: ((k > 0) & (F.get(s, k - 1)["h"] == x["h"])) | F.coalesce(F.get(s, k + 1)["h"] == x["h"], F.lit(False))))
        starts = F.array_sort(F.transform(twice, lambda x: x["i"]))
        return let(starts, lambda p: F.aggregate(F.transform(p, lambda x, k: F.least(F.coalesce(F.get(p, k + 1) - x, F.lit(WINDOW)), F.lit(WINDOW))), F.lit(0), lambda a, x: a + x))

    return let(window_hashes(word_hashes, 3), lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(covered(h)))


def counts(text: Column) -> Column:
    """A struct of the base counts and of those that the measures need."""
    text = F.coalesce(text, F.lit(""))

    def of(t: Column) -> Column:
        lines = F.filter(F.split(t, "\n"), lambda x: x.rlike(WORD))
        words = F.regexp_extract_all(t, F.lit(WORD), F.lit(0))
        return let(
            F.struct(F.transform(words, lambda w: F.xxhash64(w)).alias("w"), lines.alias("l")),
            lambda s: F.struct(
                F.size(s["w"]).cast("long").alias("n_words"),
                (F.length(t) - F.regexp_count(t, F.lit(r"[\x20\x09-\x0D]"))).cast("long").alias("word_chars"),
                F.regexp_count(t, F.lit(f"[{SYMBOLS}]")).cast("long").alias("n_symbols"),
                (F.size(s["l"]) - F.size(F.array_distinct(s["l"]))).cast("long").alias("n_dup_lines"),
                _repeat_words(s["w"]).cast("long").alias("n_repeat_words"),
                F.regexp_count(t, F.lit(r"\p{Lu}")).cast("long").alias("n_capitals"),
                F.regexp_count(t, F.lit(f"[{POINTS}]")).cast("long").alias("n_points"),
                F.size(F.filter(s["w"], lambda x, i: x == F.get(s["w"], i - 1))).cast("long").alias("n_stutter"),
            ),
        )

    return let(text, of)


def _level(measure: str) -> str:
    up, down, _ = MEASURES[measure]
    return f"1000 * rated.q.{up} div greatest(rated.q.{down}, 1)"


def _cell(level: str) -> str:
    """The lowest value of a level's cell, in SQL that Spark and DuckDB share."""
    drop = f"greatest(length(bin({level})) - {CELL_BITS}, 0)"
    return f"(({level} >> {drop}) << {drop})"


def sketches(rated: DataFrame) -> DataFrame:
    """scope (0 group, 1 language, 2 all), lang, source, measure, cell, n; rated: lang, source, levels array."""
    told = rated.select("lang", "source", F.posexplode("levels").alias("measure", "level")).withColumn("cell", F.expr(_cell("level")))
    own = told.groupBy("lang", "source", "measure", "cell").agg(F.count("*").alias("n")).withColumn("scope", F.lit(0))
    lang = own.groupBy("lang", "measure", "cell").agg(F.sum("n").alias("n")).withColumn("scope", F.lit(1)).withColumn("source", F.lit(None).cast("string"))
    every = lang.groupBy("measure", "cell").agg(F.sum("n").alias("n")).withColumn("scope", F.lit(2)).withColumn("source", F.lit(None).cast("string")).withColumn("lang", F.lit(None).cast("string"))
    return own.unionByName(lang).unionByName(every)


def fences(sketch: DataFrame) -> DataFrame:
    """scope, lang, source, fences (array of lo and hi by measure), n: read from the merged sketches."""
    by = ["scope", "lang", "source", "measure"]
    reached = F.sum("n").over(Window.partitionBy(*by).orderBy("cell"))
    q = sketch.select(*by, "cell", reached.alias("reached"), F.sum("n").over(Window.partitionBy(*by)).alias("all_n"))
    at = [F.min(F.when(F.col("reached") * 100 >= F.col("all_n") * p, F.col("cell"))).alias(f"q{p}") for p in QUANTILES]
    q = q.groupBy(*by).agg(*at, F.max("all_n").alias("n"))
    low, mid, high = (F.col(f"q{p}") for p in QUANTILES)
    two_sided = F.array(*[F.lit(x[2]) for x in MEASURES.values()])
    hi = high + FENCE * F.greatest(high - mid, F.lit(1))
    lo = F.when(two_sided[F.col("measure")], low - FENCE * F.greatest(mid - low, F.lit(1))).otherwise(F.lit(-1))
    fence = F.sort_array(F.collect_list(F.struct("measure", lo.cast("long").alias("lo"), hi.cast("long").alias("hi"))))
    return q.groupBy("scope", "lang", "source").agg(fence.alias("fences"), F.max("n").alias("n"))


def rate(docs: DataFrame, keep: Column) -> DataFrame:
    """keep, and rated: a struct of the counts q, lang, source, failed and levels, of each of docs."""
    told = F.struct(counts(F.col("text")).alias("q"), F.col("lang").cast("string").alias("lang"), F.col("source").cast("string").alias("source"))
    failed = F.expr(f"rated.q.n_words < {LEAST_WORDS} or 100 * rated.q.n_repeat_words > {REPEATED_PERCENT} * rated.q.n_words")
    levels = F.array(*[F.expr(_level(m)) for m in MEASURES])
    return docs.select(keep, told.alias("rated")).withColumn("rated", F.struct("rated.*", failed.alias("failed"), levels.alias("levels")))


def verdicts(rated: DataFrame, spread: Column) -> DataFrame:
    """rated with a column verdict: true if no measure is beyond the fence of its group, or of the first wider one that is large enough."""
    table = stage(fences(sketches(rated.where("rated.q.n_words > 0").select("rated.lang", "rated.source", "rated.levels"))), "fences")
    own = table.where("scope = 0").select(F.col("lang").alias("f_lang"), F.col("source").alias("f_source"), F.col("n").alias("f_n"), F.col("fences").alias("f_own"))
    lang = table.where("scope = 1").select(F.col("lang").alias("l_lang"), F.col("n").alias("l_n"), F.col("fences").alias("f_lang_f"))
    every = table.where("scope = 2").select(F.col("fences").alias("f_all"))
    lang = join_small(lang, every, F.lit(True), F.col("l_lang"))  # one row
    own = join_small(own, lang, F.col("f_lang").eqNullSafe(F.col("l_lang")), F.col("f_source"))
    chosen = F.when(F.col("f_n") >= LEAST_GROUP, F.col("f_own")).when(F.col("l_n") >= LEAST_GROUP, F.col("f_lang_f")).otherwise(F.col("f_all"))
    own = own.select("f_lang", "f_source", chosen.alias("f_fences"))
    on = F.col("rated.lang").eqNullSafe(F.col("f_lang")) & F.col("rated.source").eqNullSafe(F.col("f_source"))
    beyond = F.exists(F.arrays_zip(F.col("rated.levels").alias("a"), F.col("f_fences").alias("b")), lambda x: F.coalesce((x["a"] > x["b"]["hi"]) | (x["a"] < x["b"]["lo"]), F.lit(False)))
    return join_small(rated, own, on, spread).withColumn("verdict", ~beyond)


GOOD = "not rated.failed and coalesce(verdict, true)"


def rate_documents(docs: DataFrame) -> DataFrame:
    """doc_id, the base counts, base_failed and kept of each document."""
    rated = stage(rate(docs, F.col("doc_id")), "rated")
    out = verdicts(rated, F.col("doc_id"))
    return out.select("doc_id", *[F.col(f"rated.q.{c}").alias(c) for c in COUNTS], F.col("rated.failed").alias("base_failed"), F.expr(GOOD).alias("kept"))


def keep_good(docs: DataFrame) -> DataFrame:
    """The rows and columns of docs that the base rule and the method keep."""
    rated = stage(rate(docs, F.struct(*[docs[c] for c in docs.columns]).alias("doc")), "rated")
    return verdicts(rated, F.col("doc.doc_id")).where(GOOD).select("doc.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rate_documents(read(spark, sf_dir, "documents"))


_MEASURED = ",\n".join(f"(1000 * {up}) // greatest({down}, 1) as m{i}" for i, (up, down, _) in enumerate(MEASURES.values()))
_TOLD = " union all ".join(f"select lang, source, {i} as measure, {x[2]} as two_sided, {_cell(f'm{i}')} as cell from measured where n_words > 0" for i, x in enumerate(MEASURES.values()))
_BEYOND = " or ".join(f"coalesce((select m{i} > hi or m{i} < lo from chosen c where c.lang is not distinct from m.lang and c.source is not distinct from m.source and c.measure = {i}), false)" for i in range(len(MEASURES)))
_QUANTILES = ", ".join(f"min(cell) filter (reached * 100 >= n * {p}) as q{p}" for p in QUANTILES)
_WORD = r"[^\x20\x09-\x0D]+"
#: DuckDB SQL for the rows of query(), and with the columns of documents kept for those of keep_good().
RATED_SQL = rf"""
texts as (select row_number() over () as rid, *, coalesce(text, '') as t from documents),
worded as (select rid, regexp_extract_all(t, '{_WORD}') as w, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '{_WORD}')) as l from texts),
windows as (select rid, i, array_to_string(list_slice(w, i, i + {WINDOW - 1}), ' ') as g from (select rid, w, unnest(generate_series(1, len(w) - {WINDOW - 1})) as i from worded)),
again as (select rid, i from windows qualify count(*) over (partition by rid, g) > 1),
covered as (select rid, count(distinct p) as n from (select rid, unnest(generate_series(i, i + {WINDOW - 1})) as p from again) group by rid),
counted as (select x.*, len(w)::bigint as n_words, length(translate(t, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13), ''))::bigint as word_chars,
  (length(t) - length(translate(t, '{SYMBOLS}', '')))::bigint as n_symbols, (len(l) - len(list_distinct(l)))::bigint as n_dup_lines, coalesce(c.n, 0)::bigint as n_repeat_words,
  len(regexp_extract_all(t, '\p{{Lu}}'))::bigint as n_capitals, (length(t) - length(translate(t, '{POINTS}', '')))::bigint as n_points,
  len(list_filter(w, lambda x, i: i > 1 and x = w[i - 1]))::bigint as n_stutter
  from texts x join worded using (rid) left join covered c using (rid)),
measured as (select *, {_MEASURED} from counted),
told as ({_TOLD}),
sketch as (select grouping(lang, source) as scope, lang, source, measure, cell, any_value(two_sided) as two_sided, count(*) as c
  from told group by grouping sets ((lang, source, measure, cell), (lang, measure, cell), (measure, cell))),
reach as (select *, sum(c) over (w order by cell) as reached, sum(c) over w as n from sketch window w as (partition by scope, lang, source, measure)),
quant as (select scope, lang, source, measure, any_value(two_sided) as two_sided, max(n) as n, {_QUANTILES} from reach group by all),
fence as (select *, q90 + {FENCE} * greatest(q90 - q50, 1) as hi, case when two_sided then q10 - {FENCE} * greatest(q50 - q10, 1) else -1 end as lo from quant),
wide as (select o.lang, o.source, o.measure, case when o.n >= {LEAST_GROUP} then o when l.n >= {LEAST_GROUP} then l else a end as f
  from fence o join fence l on l.scope = 1 and l.measure = o.measure and l.lang is not distinct from o.lang join fence a on a.scope = 3 and a.measure = o.measure where o.scope = 0),
chosen as (select lang, source, measure, f.lo as lo, f.hi as hi from wide),
judged as (select *, n_words < {LEAST_WORDS} or 100 * n_repeat_words > {REPEATED_PERCENT} * n_words as base_failed, {_BEYOND} as beyond from measured m)
"""
SQL = f"with {RATED_SQL} select doc_id, {', '.join(COUNTS)}, base_failed, not base_failed and not beyond as kept from judged"
