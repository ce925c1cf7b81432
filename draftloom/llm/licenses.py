"""License scan by diagonal voting.

The hash of every rolling word k-gram of a text is joined in Spark to the
positions that it has in the templates, a fixed table.  A copy of a template
puts its hits on one diagonal (text position minus template position); inserted
or missing words shift the rest to a neighbouring one.  Hits are aggregated by
diagonal, neighbouring diagonals are merged, and a merged span counts if enough
of the template's k-grams vote for it, each once.  Only then are words fetched: the
span's words and the template's are aligned, and enough of the template's words
must stand in it in their order.  A phrase is a template whose k-grams must all
vote on a single diagonal.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import scratch

#: Fixed phrases and their labels.
PHRASES: tuple[tuple[str, str], ...] = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))

_AS_IS = (
    "The software is provided as is, without warranty of any kind, express or implied, including but not limited to the warranties of merchantability, fitness for a particular "
    "purpose and noninfringement. In no event shall the authors or copyright holders be liable for any claim, damages or other liability, whether in an action of contract, tort or "
    "otherwise, arising from, out of or in connection with the software or the use or other dealings in the software."
)
_BSD_2 = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
    "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
    "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. "
)
_BSD_3 = "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. "
_BSD_END = (
    "This software is provided by the copyright holders and contributors as is and any express or implied warranties, including, but not limited to, the implied warranties of merchantability and "
    "fitness for a particular purpose are disclaimed. In no event shall the copyright holder or contributors be liable for any direct, indirect, incidental, special, exemplary, or consequential damages "
    "(including, but not limited to, procurement of substitute goods or services; loss of use, data, or profits; or business interruption) however caused and on any theory of liability, whether in contract, "
    "strict liability, or tort (including negligence or otherwise) arising in any way out of the use of this software, even if advised of the possibility of such damage."
)
#: Whole licenses, and the notices that others ask for, as they are published (fixed values).
TEXTS: tuple[tuple[str, str], ...] = (
    (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, "
        "including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished "
        "to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. " + _AS_IS, "mit",
    ),
    (_BSD_2 + _BSD_END, "bsd-2"),
    (_BSD_2 + _BSD_3 + _BSD_END, "bsd-3"),
    (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in "
        "all copies. The software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness. In no event shall the "
        "author be liable for any special, direct, indirect, or consequential damages or any damages whatsoever resulting from loss of use, data or profits, whether in an action of contract, negligence or other "
        "tortious action, arising out of or in connection with the use or performance of this software.", "isc",
    ),
    (
        "This software is provided as-is, without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to "
        "anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: The origin of this software must not "
        "be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not "
        "required. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. This notice may not be removed or altered from any source distribution.", "zlib",
    ),
    (
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at "
        "http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an as is basis, without warranties or "
        "conditions of any kind, either express or implied. See the License for the specific language governing permissions and limitations under the License.", "apache",
    ),
    (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.", "mpl",
    ),
    (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, "
        "or (at your option) any later version. This program is distributed in the hope that it will be useful, but without any warranty; without even the implied warranty of merchantability or fitness for a "
        "particular purpose. See the GNU General Public License for more details. You should have received a copy of the GNU General Public License along with this program. If not, see https://www.gnu.org/licenses/.", "gpl",
    ),
    (
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a "
        "compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright "
        "interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt "
        "act of relinquishment in perpetuity of all present and future rights to this software under copyright law. " + _AS_IS, "unlicense",
    ),
)


def plain_words(text: str) -> str:
    """The words of a template, as texts are cut into words, with a space between."""
    return " ".join(w.lower() for w in re.findall("[A-Za-z0-9]+", text))


#: Short notices, and the whole texts; by words.
NOTICES: tuple[tuple[str, str], ...] = (
    ("released under the mit license", "mit"),
    ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "mit"),
    ("licensed under the apache license version 2 0", "apache"),
    ("you may not use this file except in compliance with the license you may obtain a copy of the license at", "apache"),
    ("licensed under cc by nc 4 0", "cc-by-nc"),
    ("this work is licensed under a creative commons attribution 4 0 international license", "cc-by"),
    ("this work is licensed under a creative commons attribution sharealike 4 0 international license", "cc-by-sa"),
    ("this work is licensed under the gnu general public license version 3", "gpl"),
    ("this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation", "gpl"),
    ("redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "bsd"),
    ("this source code form is subject to the terms of the mozilla public license v 2 0", "mpl"),
    ("permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "isc"),
    ("this is free and unencumbered software released into the public domain", "unlicense"),
)
TEMPLATES = (*NOTICES, *((plain_words(t), label) for t, label in TEXTS))


def words_of(text: Column) -> Column:
    """A-Z lower-cased, then words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+``."""
    low = F.translate(F.coalesce(text, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.array_remove(F.split(low, r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"), "")


def word_hashes(text: Column) -> Column:
    return F.transform(words_of(text), lambda w: F.xxhash64(w))


def _gram(k: int) -> Column:
    """Hash of the k words of h from pos on; null beyond the end."""
    return F.when(F.col("pos") + k <= F.size("h"), F.xxhash64(*[F.get("h", F.col("pos") + i) for i in range(k)]))


def _grams(rows: DataFrame, sizes: tuple[int, ...], *keep: str) -> DataFrame:
    """(keep..., h, pos, k, seed): every rolling k-gram of h, made by generators that do not copy h."""
    spread = rows.where(F.size("h") >= min(sizes)).select(*keep, "h", F.explode(F.sequence(F.lit(0), F.size("h") - min(sizes))).alias("pos"))
    both = F.array(*[F.struct(F.lit(k).alias("k"), _gram(k).alias("seed")) for k in sizes])
    return spread.select(*keep, "h", "pos", F.inline(both)).where("seed is not null")


_TEMPLATE = "template int, label string, phrase boolean, text string"


def template_tables(spark: SparkSession, phrases: tuple = PHRASES, templates: tuple = TEMPLATES, k: int = 3) -> tuple[DataFrame, DataFrame]:
    """(template, label, phrase, words, grams, th), a row per template with the hashes of its words, and (template, k, seed, tpos), a row per k-gram."""
    rows = [(i, label, i < len(phrases), text) for i, (text, label) in enumerate((*phrases, *templates))]
    t = spark.createDataFrame(rows, _TEMPLATE).withColumn("h", word_hashes(F.col("text"))).withColumn("words", F.size("h")).withColumn("own", F.least(F.lit(k), F.col("words")))
    sizes = tuple(sorted({min(k, len(r[3].split())) for r in rows}))
    grams = _grams(t, sizes, "template", "own").where("k = own")
    return t.select("template", "label", "phrase", "words", (F.col("words") - F.col("own") + 1).alias("grams"), F.col("h").alias("th")), grams.select("template", "k", "seed", F.col("pos").alias("tpos"))


def in_order(a: list[int], b: list[int]) -> int:
    """How many words of a stand in b in their order (longest common subsequence).

    A bit a word of a: those that are still set after all of b are the words left
    over, so a word of b costs a few operations on one number of len(a) bits.
    """
    where: dict[int, int] = {}
    for i, x in enumerate(a):
        where[x] = where.get(x, 0) | 1 << i
    every = (1 << len(a)) - 1
    left = every
    for y in b:
        own = left & where.get(y, 0)
        left = (left + own | left - own) & every
    return len(a) - left.bit_count()


def scan(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", phrases: tuple = PHRASES, templates: tuple = TEMPLATES,
    k: int = 3, drift: int = 3, share: float = 0.6, votes: float = 0.3, long: int = 30, broadcast_spans: int = 100_000,
) -> tuple[DataFrame, DataFrame]:
    """(texts, spans): texts has (k1, k2, doc_id, n_words), a row per row of docs, and spans one per place found in
    a text: (k1, k2, template, label, phrase, first, last, coverage), words counted from 0.  (k1, k2) is the text's hash.

    drift: diagonals this far apart, at most, may belong to one copy.
    share: part of a template's words that must stand in a span in order (coverage),
    and of its k-grams that must vote for it; of templates of ``long`` words and
    more, whose k-grams are rarely met elsewhere, ``votes`` of them.
    The templates are few and fixed, whatever the corpus: their k-grams and their words
    are broadcast, each by itself.  The words of a text are fetched for voted spans only,
    which are broadcast up to broadcast_spans of them, beyond that joined by shuffle.
    """
    spark = docs.sparkSession
    heads, grams = (scratch.table(t, "license-templates") for t in template_tables(spark, phrases, templates, k))
    about = F.broadcast(heads.drop("th"))
    sizes = tuple(r[0] for r in grams.select("k").distinct().orderBy("k").collect())
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    keys = [F.xxhash64(text).alias("k1"), F.xxhash64(F.lit(2), text).alias("k2")]
    found = _grams(docs.select(*keys, word_hashes(text).alias("h")), sizes, "k1", "k2").join(F.broadcast(grams), ["k", "seed"])
    hits = found.select("k1", "k2", "template", "pos", "tpos", (F.col("pos") - F.col("tpos")).alias("diag"))
    diag = hits.groupBy("k1", "k2", "template", "diag").agg(F.min("pos").alias("lo"), F.max("pos").alias("hi"), F.collect_set("tpos").alias("votes"))
    texts = docs.select(*keys, F.col(id_col).cast("long").alias("doc_id"), F.size(words_of(text)).cast("long").alias("n_words"))
    diag = scratch.table(diag, "license-diagonals").join(about, "template")
    whole = diag.where(F.col("phrase") & (F.size("votes") == F.col("grams"))).select(
        "k1", "k2", "template", "label", "phrase", F.col("diag").cast("long").alias("first"), (F.col("diag") + F.col("words") - 1).cast("long").alias("last"), F.lit(1.0).alias("coverage"))
    # a copy's diagonals differ by little from one to the next, and its pieces follow each other closely in the text
    copy = Window.partitionBy("k1", "k2", "template")
    parts = diag.where("not phrase").withColumn("new", (F.col("diag") - F.lag("diag").over(copy.orderBy("diag")) > drift).cast("int"))
    parts = parts.withColumn("band", F.coalesce(F.sum("new").over(copy.orderBy("diag")), F.lit(0)))
    band = Window.partitionBy("k1", "k2", "template", "band").orderBy("lo", "diag")
    gap = (F.col("lo") - F.lag("hi").over(band) > F.col("words")).cast("int")
    parts = parts.withColumn("gap", gap).withColumn("piece", F.coalesce(F.sum("gap").over(band.rowsBetween(Window.unboundedPreceding, 0)), F.lit(0)))
    merged = parts.groupBy("k1", "k2", "template", "band", "piece", "grams", "words").agg(
        F.min("lo").alias("first"), (F.max("hi") + k - 1).alias("last"), F.size(F.array_distinct(F.flatten(F.collect_list("votes")))).alias("votes"))
    need = F.when(F.col("words") >= long, F.lit(votes)).otherwise(F.lit(share))
    voted = scratch.table(merged.where(F.col("votes") >= F.col("grams") * need).select("k1", "k2", "template", "first", "last"), "license-voted")

    @F.pandas_udf("double")
    def verified(template: pd.Series, span: pd.Series) -> pd.Series:
        return pd.Series([in_order(a.tolist(), b.tolist()) / len(a) for a, b in zip(template, span)])

    listed = voted.groupBy("k1", "k2").agg(F.collect_list(F.struct("template", "first", "last")).alias("l"))
    rows = docs.select(*keys, text.alias("t")).join(F.broadcast(listed) if voted.count() <= broadcast_spans else listed, ["k1", "k2"])
    spans = rows.select("k1", "k2", "l", word_hashes(F.col("t")).alias("h")).select("k1", "k2", "h", F.inline("l")).join(F.broadcast(heads), "template")
    span = F.slice("h", F.col("first") + 1, F.least(F.col("last") - F.col("first") + 1, 2 * F.col("words")))
    checked = spans.select("k1", "k2", "template", "label", "phrase", "first", "last", "th", span.alias("span")).withColumn("coverage", verified("th", "span")).where(F.col("coverage") >= share)
    sure = checked.select("k1", "k2", "template", "label", "phrase", F.col("first").cast("long").alias("first"), F.col("last").cast("long").alias("last"), "coverage").distinct()
    return texts, whole.unionByName(sure)


def license_labels(docs: DataFrame, broadcast_texts: int = 200_000, **options) -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score), one row per input row.

    n_base counts the places of fixed phrases, first_word and last_word are the
    smallest and largest start among them (null if there is none).  labels also
    has those of license notices; score is the best share of a template found.
    Null and empty texts have no words and no labels ('').  Rows are judged each
    by its own text, also where they repeat an id or it is null.  Other columns
    are ignored.  An empty table gives an empty result.  What is found in up to
    broadcast_texts texts is broadcast to their rows, beyond that joined by shuffle.
    """
    texts, spans = scan(docs, **options)
    joined = lambda c: F.array_join(F.array_sort(F.collect_set(c)), ",")
    per = spans.groupBy("k1", "k2").agg(
        F.count_if("phrase").alias("n_base"), F.min(F.when(F.col("phrase"), F.col("first"))).alias("first_word"), F.max(F.when(F.col("phrase"), F.col("first"))).alias("last_word"),
        joined(F.when(F.col("phrase"), F.col("label"))).alias("base_labels"), joined("label").alias("labels"), F.max("coverage").alias("score"))
    per = scratch.table(per, "license-found")
    per = F.broadcast(per) if per.count() <= broadcast_texts else per
    return texts.join(per, ["k1", "k2"], "left").select(
        "doc_id", "n_words", F.coalesce("n_base", F.lit(0)).alias("n_base"), "first_word", "last_word",
        F.coalesce("base_labels", F.lit("")).alias("base_labels"), F.coalesce("labels", F.lit("")).alias("labels"), F.coalesce("score", F.lit(0.0)).alias("score"))


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_labels(spark.read.parquet(f"{sf_dir}/documents.parquet"))
