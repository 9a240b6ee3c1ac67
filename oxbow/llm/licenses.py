"""License scans by diagonal voting.

All rolling word k-grams of all texts are joined by hash with the places of the same k-grams in the license templates.
A match at word d of the text and word t of the template votes for the diagonal d - t: a copied passage puts
all its votes on one, and words put in or left out move it by a few.  Neighbouring diagonals, at most SHIFT apart, are
merged to a span, which is verified by the share of its template's k-grams that voted for it, each counted once:
COVERAGE at least, and half of those that no template of another label has, so versions of one text are told apart.
Beside the method's labels stand those of the base phrases, which are found word by word.

One Arrow pass cuts each text into words and gives its length, its base places and its k-grams.  K-grams that no
template has can cast no vote; they are left out there, so only those of the templates are joined (of more than
KNOWN_GRAMS, too many for a task to hold, none is left out, and the join does all of it).  Votes belong to
texts, not rows: exact copies of a text are one key, pre-aggregated before the shuffle, and a diagonal keeps a set of
template places, which the template bounds.

Defined results: a null or empty text has no words, empty labels, score 0 and null words.  Repeated rows get equal
results.  An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._common import LOWER, UPPER, join_small, read, stage

#: Phrase: label.
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
K, SHIFT, COVERAGE, BASE_SCORE = 4, 3, 0.6, 0.5
KNOWN_GRAMS, SEED = 1_000_000, 42
#: (label, text): how licenses are usually named and granted.
TEMPLATES = [
    ("gpl-3.0", "licensed under the gnu general public license version 3"),
    ("gpl-3.0", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version"),
    ("gpl-2.0", "licensed under the gnu general public license version 2"),
    ("gpl-2.0", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version"),
    ("apache-2.0", "licensed under the apache license version 2 0"),
    ("apache-2.0", "you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0"),
    ("mit", "released under the mit license"),
    ("mit", "licensed under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction"),
    ("cc-by-4.0", "licensed under cc by 4 0"),
    ("cc-by-sa-4.0", "licensed under cc by sa 4 0"),
    ("cc-by-nc-4.0", "licensed under cc by nc 4 0"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("bsd", "this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed"),
    ("mit", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    ("mit", "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"),
    ("apache-2.0", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied"),
    ("agpl-3.0", "it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version"),
    ("lgpl-2.1", "it under the terms of the gnu lesser general public license as published by the free software foundation either version 2 1 of the license or at your option any later version"),
    ("lgpl-3.0", "it under the terms of the gnu lesser general public license as published by the free software foundation either version 3 of the license or at your option any later version"),
    ("unlicense", "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software"),
    ("cc0-1.0", "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work"),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0"),
]


#: Words are runs of ASCII letters and digits and of all bytes beyond ASCII; A-Z count as lower-case.
_CUT = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or bytes([c]).isalnum() else 32 for c in range(256))


def words_of(text: bytes | None) -> list[bytes]:
    """text in UTF-8."""
    return (text or b"").translate(_CUT).split()


def _grams(words: list[bytes]) -> Iterator[tuple[bytes, ...]]:
    return zip(*(words[k:] for k in range(K)), strict=False)


def _hash(gram: tuple[bytes, ...]) -> int:
    return int.from_bytes(xxhash.xxh64_digest(b" ".join(gram), SEED), "big", signed=True)


_BASE = [(p.encode().split(), label) for p, label in PHRASES.items()]


def _base(words: list[bytes]) -> list[tuple[int, str]]:
    """The places where a phrase starts, and its label."""
    out = []
    for phrase, label in _BASE:
        at = -1
        while True:
            try:
                at = words.index(phrase[0], at + 1)
            except ValueError:
                break
            if words[at : at + len(phrase)] == phrase:
                out.append((at, label))
    return out


def templates(spark: SparkSession, table: list[tuple[str, str]] = TEMPLATES) -> DataFrame:
    """template, label, grams and owned (how many it has, and how many no other label has), place, words, gram, own of every k-gram of every template."""
    t = [(n, label, [(" ".join(x.decode() for x in g), _hash(g)) for g in _grams(words_of(text.encode()))]) for n, (label, text) in enumerate(table)]
    t = spark.createDataFrame(t, "template int, label string, g array<struct<words: string, gram: long>>")
    t = t.select("template", "label", F.size("g").alias("grams"), F.posexplode("g").alias("place", "g")).select("template", "label", "grams", "place", "g.words", "g.gram")
    t = t.withColumn("own", F.size(F.collect_set("label").over(Window.partitionBy("gram"))) == 1)
    return t.withColumn("owned", F.count_if("own").over(Window.partitionBy("template")))


_ROW = pa.schema([
    ("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("base", pa.list_(pa.string())),
    ("text_key", pa.string()), ("grams", pa.list_(pa.struct([("at", pa.int32()), ("gram", pa.int64())]))),
])
_ROW_SQL = "doc_id long, n_words long, n_base long, first_word long, last_word long, base array<string>, text_key string, grams array<struct<at: int, gram: long>>"


def _cutter(known: frozenset[tuple[bytes, ...]] | None):
    def of(doc_id: int | None, text: bytes | None) -> tuple:
        words = words_of(text)
        base = _base(words)
        at = [i for i, _ in base]
        grams = [] if known is not None and known.isdisjoint(_grams(words)) else [{"at": i, "gram": _hash(g)} for i, g in enumerate(_grams(words)) if known is None or g in known]
        key = hashlib.md5(text, usedforsecurity=False).hexdigest() if grams else None
        return doc_id, len(words), len(base), min(at, default=None), max(at, default=None), sorted({x for _, x in base}), key, grams

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [of(d, t) for d, t in zip(batch.column(0).to_pylist(), (x.as_py() for x in batch.column(1)), strict=True)]
            columns = zip(*rows, strict=True) if rows else [[]] * len(_ROW)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _ROW, strict=True)], schema=_ROW)

    return run


def cut(docs: DataFrame, table: DataFrame) -> DataFrame:
    """doc_id, the base columns, and text_key and grams (at, gram) of those of table, null and empty if there are none, of each document."""
    known = table.select("words").distinct().limit(KNOWN_GRAMS + 1).collect()
    known = frozenset(tuple(r[0].encode().split()) for r in known) if len(known) <= KNOWN_GRAMS else None
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string").cast("binary")).mapInArrow(_cutter(known), _ROW_SQL)


def spans(texts: DataFrame, table: DataFrame) -> DataFrame:
    """text_key, label, first, last (words, inclusive), coverage of each verified span; texts: text_key, grams (at, gram)."""
    places = table.select("template", "place", "own", F.col("gram").alias("t_gram"))
    told = texts.select("text_key", F.explode("grams").alias("g")).select("text_key", "g.at", "g.gram")
    hits = join_small(told, places, F.col("gram") == F.col("t_gram"), F.col("at"), "inner")
    by = ["text_key", "template"]
    lines = hits.groupBy(*by, (F.col("at") - F.col("place")).alias("diagonal")).agg(F.min("at").alias("first"), F.max("at").alias("last"), F.collect_set("place").alias("places"), F.collect_set(F.when(F.col("own"), F.col("place"))).alias("own_places"))
    order = Window.partitionBy(*by).orderBy("diagonal")
    lines = lines.withColumn("new", F.when(F.col("diagonal") - F.lag("diagonal").over(order) <= SHIFT, 0).otherwise(1))
    lines = lines.withColumn("span", F.sum("new").over(order))
    together = lambda c: F.size(F.array_distinct(F.flatten(F.collect_list(c))))
    merged = lines.groupBy(*by, "span").agg(F.min("first").alias("first"), (F.max("last") + K - 1).alias("last"), together("places").alias("voted"), together("own_places").alias("own_voted"))
    known = table.select(F.col("template").alias("t"), "label", "grams", "owned").distinct()
    merged = join_small(merged, known, F.col("template") == F.col("t"), F.col("text_key"), "inner")
    return merged.withColumn("coverage", F.col("voted") / F.col("grams")).where((F.col("coverage") >= COVERAGE) & (2 * F.col("own_voted") >= F.col("owned"))).select("text_key", "label", "first", "last", "coverage")


def scan(docs: DataFrame, table: DataFrame) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score of each document."""
    rows = stage(cut(docs, table), "grams")
    voting = rows.where("text_key is not null")
    found = spans(voting.select("text_key", "grams"), table).groupBy("text_key").agg(F.collect_set("label").alias("added"), F.max("coverage").alias("coverage"))
    met = voting.drop("grams").join(found.withColumnRenamed("text_key", "f_key"), F.col("text_key") == F.col("f_key"), "left").drop("f_key")
    rest = rows.where("text_key is null").drop("grams").withColumns({"added": F.array().cast("array<string>"), "coverage": F.lit(None).cast("double")})
    labels = F.array_union("base", F.coalesce("added", F.array().cast("array<string>")))
    return met.unionByName(rest).select(
        "doc_id", "n_words", "n_base", "first_word", "last_word", F.array_join("base", ",").alias("base_labels"), F.array_join(F.array_sort(labels), ",").alias("labels"),
        F.greatest(F.coalesce("coverage", F.lit(0.0)), F.when(F.col("n_base") > 0, F.lit(BASE_SCORE)).otherwise(F.lit(0.0))).alias("score"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(read(spark, sf_dir, "documents"), templates(spark))


_T = ", ".join(f"({n}, '{label}', '{text}')" for n, (label, text) in enumerate(TEMPLATES))
_P = ", ".join(f"('{p}', '{label}', {len(p.split())})" for p, label in PHRASES.items())
_GRAM = f"array_to_string(list_slice(w, i, i + {K - 1}), ' ')"
SQL = rf"""
with docs as (select row_number() over () as rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents),
t(template, label, body) as (values {_T}),
placed as (select template, label, i - 1 as place, {_GRAM} as gram, len(w) - {K - 1} as grams from (select template, label, w, unnest(generate_series(1, len(w) - {K - 1})) as i from (select *, string_split(body, ' ') as w from t))),
owning as (select gram, count(distinct label) = 1 as own from placed group by gram),
places as (select *, sum(own::int) over (partition by template) as owned from placed join owning using (gram)),
told as (select rid, i - 1 as nth, {_GRAM} as gram from (select rid, w, unnest(generate_series(1, len(w) - {K - 1})) as i from docs)),
votes as (select rid, template, label, grams, owned, nth - place as diagonal, place, own from told join places using (gram)),
starts as (select *, case when diagonal - lag(diagonal) over (partition by rid, template order by diagonal) <= {SHIFT} then 0 else 1 end as fresh from (select distinct rid, template, diagonal from votes)),
merged as (select *, sum(fresh) over (partition by rid, template order by diagonal) as span from starts),
voted as (select rid, label, count(distinct place) / any_value(grams) as coverage, 2 * count(distinct place) filter (own) >= any_value(owned) as owns from votes join merged using (rid, template, diagonal) group by rid, template, span, label),
added as (select rid, list(distinct label) as labels, max(coverage) as coverage from voted where coverage >= {COVERAGE} and owns group by rid),
hits as (select rid, i - 1 as nth, label from (select rid, w, unnest(generate_series(1, len(w))) as i from docs), (values {_P}) p(phrase, label, n) where w[i] = string_split(phrase, ' ')[1] and array_to_string(list_slice(w, i, i + n - 1), ' ') = phrase),
base as (select rid, count(*) as n, min(nth) as lo, max(nth) as hi, list_sort(list(distinct label)) as labels from hits group by rid)
select doc_id, len(w)::bigint as n_words, coalesce(b.n, 0)::bigint as n_base, b.lo::bigint as first_word, b.hi::bigint as last_word, coalesce(array_to_string(b.labels, ','), '') as base_labels,
  coalesce(array_to_string(list_sort(list_distinct(list_concat(coalesce(b.labels, []), coalesce(a.labels, [])))), ','), '') as labels,
  greatest(coalesce(a.coverage, 0.0), case when b.n > 0 then {BASE_SCORE} else 0.0 end)::double as score
from docs left join base b using (rid) left join added a using (rid)
"""
