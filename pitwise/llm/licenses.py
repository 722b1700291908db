"""License scans by diagonal voting; DataFrame functions only.

Rolling word k-grams of every text are joined by hash to the positions at which license phrases and
notices have them. A hit votes for the diagonal (text position less template position); diagonals
close to each other are merged, as words put in or left out shift them; a span counts once enough
of its template's words are verified, each word of the template once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import field
from .linededup import ascii_lower

# Phrases that count exactly, and their labels.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}
# Openings of public license notices, and whole short licenses and notices, with their labels.
NOTICES = [
    ("apache", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by-nc", "this work is licensed under a creative commons attribution noncommercial 4 0 international license"),
    ("cc-by-sa", "this work is licensed under a creative commons attribution sharealike 4 0 international license"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    ("gpl-3", "licensed under the gnu general public license version 3"),
    ("apache-2", "licensed under the apache license version 2 0"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    (
        "mit",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction "
        "including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so "
        "subject to the following conditions the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software "
        "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement "
        "in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with "
        "the software or the use or other dealings in the software",
    ),
    (
        "bsd",
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met "
        "1 redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer "
        "2 redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution "
        "this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness "
        "for a particular purpose are disclaimed in no event shall the copyright holder or contributors be liable for any direct indirect incidental special exemplary or consequential damages including "
        "but not limited to procurement of substitute goods or services loss of use data or profits or business interruption however caused and on any theory of liability whether in contract strict liability "
        "or tort including negligence or otherwise arising in any way out of the use of this software even if advised of the possibility of such damage",
    ),
    (
        "isc",
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies "
        "the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness "
        "in no event shall the author be liable for any special direct indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits "
        "whether in an action of contract negligence or other tortious action arising out of or in connection with the use or performance of this software",
    ),
    (
        "zlib",
        "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software "
        "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions "
        "1 the origin of this software must not be misrepresented you must not claim that you wrote the original software if you use this software in a product an acknowledgment in the product documentation "
        "would be appreciated but is not required 2 altered source versions must be plainly marked as such and must not be misrepresented as being the original software "
        "3 this notice may not be removed or altered from any source distribution",
    ),
    (
        "apache",
        "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at "
        "http www apache org licenses license 2 0 unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis "
        "without warranties or conditions of any kind either express or implied see the license for the specific language governing permissions and limitations under the license",
    ),
    (
        "gpl",
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation "
        "either version 3 of the license or at your option any later version this program is distributed in the hope that it will be useful but without any warranty "
        "without even the implied warranty of merchantability or fitness for a particular purpose see the gnu general public license for more details "
        "you should have received a copy of the gnu general public license along with this program if not see",
    ),
    (
        "unlicense",
        "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software "
        "either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means",
    ),
    (
        "bsl",
        "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license the software "
        "to use reproduce display distribute execute and transmit the software and to prepare derivative works of the software and to permit third parties to whom the software is furnished to do so",
    ),
]
#: Words of a gram: of exact phrases and of notices.
PHRASE_GRAM, NOTICE_GRAM = 2, 4
#: Diagonals this far apart merge; this share of a notice's words must be verified.
DRIFT, COVERAGE = 3, 0.8
#: All that is no word character (ASCII letters and digits, everything beyond ASCII).
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text: Column) -> Column:
    """Words of the text, A-Z lower-cased; none for null."""
    bare = F.regexp_replace(ascii_lower(F.coalesce(text, F.lit(""))), f"^{BETWEEN}|{BETWEEN}$", "")
    return F.when(F.length(bare) == 0, F.array().cast("array<string>")).otherwise(F.split(bare, BETWEEN))


def templates(spark: SparkSession) -> DataFrame:
    """(k, h, gram, template, label, exact, n, tpos): the fixed table of template positions, a few hundred rows."""
    rows = []
    for exact, k, given in ((True, PHRASE_GRAM, [(v, p) for p, v in PHRASES.items()]), (False, NOTICE_GRAM, NOTICES)):
        for number, (label, phrase) in enumerate(given):
            words = phrase.split()
            rows += [(k, words[i : i + k], 2 * number + exact, label, exact, len(words), i) for i in range(len(words) - k + 1)]
    df = spark.createDataFrame(rows, "k int, gram array<string>, template int, label string, exact boolean, n int, tpos int")
    gram = [F.get("gram", F.lit(i)) for i in range(NOTICE_GRAM)]
    return df.withColumn("h", F.when(F.col("k") == PHRASE_GRAM, F.xxhash64(*gram[:PHRASE_GRAM])).otherwise(F.xxhash64(*gram)))


def votes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, tag, n_words, template columns, diag, rows, votes, low, high, cover) dealt out by document.

    Each text has one row without a template, with the number of equal rows that it stands for. The
    hits of a diagonal are no more than its template has words; ``cover`` lists the template's words
    under them, each once.
    """
    rows = docs.select(field(docs, doc_id).alias("doc_id"), F.xxhash64(field(docs, text)).alias("tag"), words_of(field(docs, text)).alias("words"))
    rows = rows.withColumn("n_words", F.size("words").cast("long")).select("doc_id", "tag", "n_words", "words", F.posexplode_outer("words").alias("pos", "word"))
    after = [F.get("words", F.col("pos") + i) for i in range(1, NOTICE_GRAM)]
    grams = [
        F.struct(F.lit(PHRASE_GRAM).alias("k"), F.xxhash64("word", *after[: PHRASE_GRAM - 1]).alias("h")),
        F.struct(F.lit(NOTICE_GRAM).alias("k"), F.xxhash64("word", *after).alias("h")),
    ]
    own = F.struct(F.lit(0).alias("k"), F.lit(0).cast("long").alias("h"))
    start = F.coalesce(F.col("pos"), F.lit(0)) == 0
    rolled = rows.withColumn("g", F.explode(F.when(start, F.array(*grams, own)).otherwise(F.array(*grams)))).withColumns({"k": F.col("g.k"), "h": F.col("g.h")}).drop("g", "word")
    known = F.broadcast(templates(docs.sparkSession))
    hit = rolled.join(known, ["k", "h"], "left")
    same = F.when(F.col("template").isNotNull(), F.slice("words", F.col("pos") + 1, F.col("k")) == F.col("gram"))
    hit = hit.filter((F.col("k") == 0) | same)
    hit = hit.select("doc_id", "tag", "n_words", "template", "label", "exact", "n", "k", "pos", (F.col("pos") - F.col("tpos")).alias("diag"))
    keys = ["doc_id", "tag", "n_words", "template", "label", "exact", "n", "k", "diag"]
    voted = hit.repartition("doc_id", "tag").groupBy(*keys).agg(F.count(F.lit(1)).alias("rows"), F.array_sort(F.collect_set("pos")).alias("at"))
    under = F.transform("at", lambda p: F.sequence(p - F.col("diag"), p - F.col("diag") + F.col("k") - 1))
    ends = {"votes": F.size("at"), "low": F.get("at", F.lit(0)), "high": F.get("at", F.size("at") - 1)}
    return voted.withColumns({**ends, "cover": F.when(~F.col("exact"), F.array_distinct(F.flatten(under)))}).drop("at")


def spans(voted: DataFrame, drift: int = DRIFT) -> DataFrame:
    """Diagonals merged with their neighbours: (..., start, end, share of the template's words verified).

    A word of the template counts once, however many of the merged diagonals verify it. Exact
    phrases aren't merged; their share is that of their grams.
    """
    by = Window.partitionBy("doc_id", "tag", "template").orderBy("low", "diag")
    apart = (F.abs(F.col("diag") - F.lag("diag").over(by)) > drift) | (F.col("low") > F.lag("high").over(by) + F.col("n"))
    fresh = F.coalesce(apart | F.col("exact"), F.lit(True)).cast("int")
    run = voted.withColumn("fresh", fresh).withColumn("run", F.sum("fresh").over(by.rowsBetween(Window.unboundedPreceding, 0)))
    merged = run.groupBy("doc_id", "tag", "n_words", "template", "label", "exact", "n", "k", "run").agg(
        F.max("rows").alias("rows"), F.min("low").alias("start"), F.max(F.col("high") + F.col("k")).alias("end"), F.flatten(F.collect_list("cover")).alias("cover"), F.min("votes").alias("votes")
    )
    share = F.when(F.col("exact"), F.col("votes") / (F.col("n") - F.col("k") + 1)).otherwise(F.size(F.array_distinct("cover")) / F.col("n"))
    return merged.withColumn("share", share).drop("cover")


def found_spans(docs: DataFrame, **columns: str) -> DataFrame:
    """(doc_id, tag, label, exact, start, end, share): verified spans by word positions, end exclusive."""
    good = F.when(F.col("exact"), F.col("votes") == F.col("n") - F.col("k") + 1).otherwise(F.col("share") >= COVERAGE)
    return spans(votes(docs, **columns)).filter(F.col("template").isNotNull() & good).select("doc_id", "tag", "label", "exact", "start", "end", "share")


def scan_licenses(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score) for every row.

    Base: places where a phrase's words stand in a row. ``labels`` adds those of notices that are
    verified to four fifths; ``score`` is the largest verified share of a template, 0 if there is
    none. Null and empty texts have no words; equal rows are scanned apart and come back as often
    as they came; null ids are an id like any other.
    """
    merged = spans(votes(docs, doc_id, text))
    base = F.col("exact") & (F.col("votes") == F.col("n") - F.col("k") + 1)
    notice = ~F.col("exact") & (F.col("share") >= COVERAGE)
    joined = lambda which: F.array_join(F.array_sort(F.collect_set(F.when(which, F.col("label")))), ",")
    out = merged.groupBy("doc_id", "tag").agg(
        F.max("n_words").alias("n_words"),
        F.max(F.when(F.col("template").isNull(), F.col("rows"))).alias("copies"),
        F.count_if(base).alias("n_base"),
        F.min(F.when(base, F.col("start"))).cast("long").alias("first_word"),
        F.max(F.when(base, F.col("start"))).cast("long").alias("last_word"),
        joined(base).alias("base_labels"),
        joined(base | notice).alias("labels"),
        F.coalesce(F.max(F.when(base | ~F.col("exact"), F.col("share"))), F.lit(0.0)).alias("score"),
    )
    return out.withColumn("_", F.explode(F.sequence(F.lit(1).cast("long"), "copies"))).drop("_", "copies", "tag")
