"""License scans by diagonal voting (DataFrame operations only).

Texts are lower-cased (A-Z only) and cut into words; every word pair (k = 2,
rolling over the whole text) is hashed and joined to the positions of the same
pair in the templates.  A hit whose two words are really those of the template
votes for the diagonal (document position minus template position) of its template.
Votes are gathered by diagonal.  A diagonal that no other within ``drift`` of it
outvotes is the main one of a span, and the votes of its neighbours up to
``drift`` away (words were inserted or dropped there) are merged into it; a span
has no more diagonals than that, so spans don't chain.

A span is verified by the share of the template's voting pairs that stand in the
document at its places (``cover``, ``min_cover`` at least) and by the pairs that
tell the license from its neighbours: those in brackets in the template must all
stand there.  Base phrases must be covered fully on one diagonal.  ``score`` is
the largest cover of a span with its bracketed pairs, 1 for a base phrase.

The template table has one row for each pair of the texts in this module, so it
is broadcast.  The exploded word pairs are never shuffled: the join and the
partial aggregation run in the scan's stage, and only hits travel.

Nulls: a null text is empty.  A document without words or hits gives a row with
no places and score 0.  Repeated rows and repeated or null ids are kept apart by
a row number.  Empty input: no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import spread

# The phrases of the base labels.
BASE_PHRASES = (
    ("cc-by", "cc by"),
    ("gpl", "general public license"),
    ("reserved", "all rights reserved"),
)

# License notices and license texts, as commonly worded, and their labels.
# Brackets are around the words that tell a license from its neighbours.
NOTICES = (
    ("apache-2.0", "licensed under the [apache license] version 2 0"),
    ("bsd", "[redistribution and use in source and binary forms] with or without modification are permitted provided that the following conditions are met"),
    ("cc-by-nc", "licensed under [cc by nc 4 0]"),
    ("cc-by-sa", "licensed under creative commons [attribution sharealike] 4 0 international"),
    ("cc0", "to the extent possible under law the author has [waived all copyright] and related rights"),
    ("gpl-3.0", "this work is licensed under the [gnu general] public license [version 3]"),
    ("isc", "permission to [use copy modify and or distribute this software] for any purpose with or without fee is hereby granted"),
    ("lgpl", "licensed under the gnu [lesser general] public license"),
    ("mit", "released under the [mit license]"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this [software and associated documentation files]"),
    ("mpl-2.0", "this source code form is subject to the terms of the [mozilla public] license"),
    ("unlicense", "this is free and [unencumbered software] released into the [public domain]"),
    (
        "bsd-text",
        "[redistribution and use in source and binary forms] with or without modification are permitted provided that the following conditions are met"
        " redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer"
        " redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution"
        " this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed"
        " in no event shall the copyright holder or contributors be liable for any direct indirect incidental special exemplary or consequential damages including but not limited to procurement of substitute goods or services"
        " loss of use data or profits or business interruption however caused and on any theory of liability whether in contract strict liability or tort including negligence or otherwise"
        " arising in any way out of the use of this software even if advised of the possibility of such damage",
    ),
    (
        "isc-text",
        "permission to [use copy modify and or distribute this software] for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"
        " the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness"
        " in no event shall the author be liable for any special direct indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits"
        " whether in an action of contract negligence or other tortious action arising out of or in connection with the use or performance of this software",
    ),
    (
        "mit-text",
        "permission is hereby granted free of charge to any person obtaining a copy of this [software and associated documentation files] the software to deal in the software without restriction"
        " including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions"
        " the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"
        " the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement"
        " in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise"
        " arising from out of or in connection with the software or the use or other dealings in the software",
    ),
    (
        "zlib-text",
        "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software"
        " permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions"
        " the origin of this software must not be misrepresented you must not claim that you wrote the original software"
        " if you use this software in a product an acknowledgment in the product documentation would be appreciated but is not required"
        " [altered source versions must be plainly marked] as such and must not be misrepresented as being the original software"
        " this notice may not be removed or altered from any source distribution",
    ),
)

#: Separators of words, after lower-casing, as a Java pattern.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: The hash of a virtual pair before each document's first word, so that every document has a hit.
START = -1


@dataclass(frozen=True)
class Template:
    number: int
    is_base: bool
    label: str
    words: tuple[str, ...]
    required: tuple[int, ...]  # positions of the pairs in brackets

    @property
    def voting(self) -> list[int]:
        """Positions of pairs that vote: not those of two words of at most three letters, unless they are in brackets."""
        return [i for i, (a, b) in enumerate(zip(self.words, self.words[1:])) if self.is_base or i in self.required or max(len(a), len(b)) > 3]


def templates(base=BASE_PHRASES, notices=NOTICES) -> list[Template]:
    out = []
    for k, (is_base, label, text) in enumerate([(True, *x) for x in base] + [(False, *x) for x in notices]):
        words, required, inside = [], [], False
        for w in text.split():
            if inside:
                required.append(len(words) - 1)
            inside = (inside or w.startswith("[")) and not w.endswith("]")
            words.append(w.strip("[]"))
        assert len(words) >= 2
        out.append(Template(k, is_base, label, tuple(words), tuple(required)))
    return out


def _pairs(spark: SparkSession, kinds: list[Template]) -> DataFrame:
    """All voting pairs of the templates."""
    rows = [f"({t.number}, {i}, '{t.words[i]}', '{t.words[i + 1]}', xxhash64('{t.words[i]}', '{t.words[i + 1]}'))" for t in kinds for i in t.voting]
    return spark.sql(f"select * from values {', '.join(rows + [f"(-1, 0, '', '', {START}L)"])} as v(tid, tpos, ta, tb, th)")


def _kinds(spark: SparkSession, kinds: list[Template]) -> DataFrame:
    """One row for each template."""
    rows = [f"({t.number}, {str(t.is_base).lower()}, '{t.label}', {len(t.voting)}, {_array(t.required)})" for t in kinds]
    return spark.sql(f"select * from values {', '.join(rows + ["(-1, false, '', 1, " + _array(()) + ")"])} as v(tid, is_base, label, n_pairs, required)")


def _array(numbers) -> str:
    return "cast(array(" + ", ".join(map(str, numbers)) + ") as array<int>)"


def license_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", base=BASE_PHRASES, notices=NOTICES, drift: int = 4, min_cover: float = 0.6) -> DataFrame:
    """``id, n_words, n_base, first_word, last_word, base_labels, labels, score, spans`` of every row.

    ``spans`` lists ``(label, first word, last word, cover)`` of every match.
    """
    spark, known = docs.sparkSession, templates(base, notices)
    words = F.filter(F.split(F.translate(F.coalesce(F.col("text"), F.lit("")), UPPER, LOWER), SEPARATORS), lambda w: w != "")
    rows = spread(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))).select(F.monotonically_increasing_id().alias("row"), "id", words.alias("words"))
    # the count is made below the explode: above it, every exploded row would carry the words
    start = f"array(named_struct('h', {START}L, 'a', '', 'b', ''))"
    pairs = f"concat({start}, zip_with(slice(words, 1, greatest(size(words) - 1, 0)), slice(words, 2, size(words)), (a, b) -> named_struct('h', xxhash64(a, b), 'a', a, 'b', b)))"
    rows = rows.select("row", "id", F.size("words").cast("long").alias("n_words"), F.expr(pairs).alias("pairs"))
    hits = rows.select("row", "id", "n_words", F.posexplode("pairs").alias("at", "x")).join(F.broadcast(_pairs(spark, known)), F.col("x.h") == F.col("th")).where((F.col("x.a") == F.col("ta")) & (F.col("x.b") == F.col("tb")))
    doc = ["row", "id", "n_words"]
    # a diagonal has each position of its template once at most
    diagonals = hits.groupBy(*doc, "tid", (F.col("at") - 1 - F.col("tpos")).cast("long").alias("diag")).agg(F.collect_list("tpos").alias("at"))
    diagonals = diagonals.withColumn("votes", F.size("at")).join(F.broadcast(_kinds(spark, known)), "tid")

    walk = Window.partitionBy("row", "tid").orderBy("diag")
    near = walk.rangeBetween(-drift, drift)
    outvoted = (F.coalesce(F.max("votes").over(walk.rangeBetween(-drift, -1)), F.lit(0)) >= F.col("votes")) | (F.coalesce(F.max("votes").over(walk.rangeBetween(1, drift)), F.lit(0)) > F.col("votes"))
    places = F.expr("transform(at, t -> named_struct('t', t, 'p', t + diag))")
    spans = diagonals.withColumn("main", F.col("is_base") | ~outvoted).withColumn("own", places).withColumn("merged", F.flatten(F.collect_list("own").over(near)))
    spans = spans.where("main").withColumn("m", F.when(F.col("is_base"), F.col("own")).otherwise(F.col("merged"))).drop("own", "merged")
    t = F.array_distinct(F.col("m.t"))
    named = F.size(F.array_except("required", t)) == 0
    spans = spans.withColumn("cover", F.when((F.col("tid") >= 0) & named & (~F.col("is_base") | (F.col("votes") == F.col("n_pairs"))), F.size(t) / F.col("n_pairs")).otherwise(F.lit(0.0)))
    spans = spans.withColumn("ok", F.col("cover") >= F.when(F.col("is_base"), F.lit(1.0)).otherwise(F.lit(min_cover)))
    is_base = F.col("ok") & F.col("is_base")
    labels = lambda on: F.array_join(F.array_sort(F.collect_set(F.when(on, F.col("label")))), ",")
    span = F.struct("label", F.array_min("m.p").alias("first_word"), (F.array_max("m.p") + 1).alias("last_word"), "cover")
    return spans.groupBy(*doc).agg(
        F.count(F.when(is_base, True)).alias("n_base"),
        F.min(F.when(is_base, F.col("diag"))).alias("first_word"),
        F.max(F.when(is_base, F.col("diag"))).alias("last_word"),
        labels(is_base).alias("base_labels"),
        labels(F.col("ok")).alias("labels"),
        F.max("cover").alias("score"),
        F.array_sort(F.collect_list(F.when(F.col("ok"), span))).alias("spans"),
    ).drop("row").withColumnRenamed("id", id_col)
