"""License scans [native]: diagonal voting over rolling word k-grams.

Every word 3-gram of every text is hashed and joined to the 3-grams of the
templates; equal hashes count only if the grams' words are equal.  A hit at
document word d and template word t votes for the diagonal d - t.  Votes are
gathered per (document, template, diagonal); neighbouring diagonals, which
differ by words put in or left out, are merged; a merged span is verified by
the share of the template's grams it covers, its last one, which tells
versions apart, among them.

A text's grams are built block by block, so a very long text holds its words
at a time, not its grams.  The templates are a fixed list, sentences and whole texts or
notices, so the side that is broadcast has a fixed size.  Hits alone are shuffled, and one row per document.

Defined cases: null text counts as empty; repeated rows give equal rows;
ties between templates give the larger score; an empty table gives none;
extra columns play no part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import ascii_lower

K = 3
#: Grams of a text that are built at a time.
BLOCK = 4096
#: Diagonals this near are one span, and the share of a template's grams that makes a label.
NEAR, COVER = 2, 0.8
BREAK = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

# Phrases whose places are counted, and their labels.
PHRASES = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}
# Clauses of the BSD family, which its two forms share.
BSD_HEAD = (
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met "
    "1 redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer "
    "2 redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution "
)
BSD_NAME = "3 neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission "
BSD_TAIL = (
    "this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed "
    "in no event shall the copyright holder or contributors be liable for any direct indirect incidental special exemplary or consequential damages including but not limited to procurement of substitute goods or services loss of use data or profits or business interruption "
    "however caused and on any theory of liability whether in contract strict liability or tort including negligence or otherwise arising in any way out of the use of this software even if advised of the possibility of such damage"
)
# Wording of common licenses and notices, and their labels.  A template's last
# words are those that tell it from its kin, as a label needs them.
TEMPLATES = (
    ("licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license", "apache-2"),
    ("licensed under the apache license version 2 0", "apache-2"),
    ("released under the mit license", "mit"),
    ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction", "mit"),
    (
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights "
        "to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions "
        "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software "
        "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement "
        "in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software",
        "mit",
    ),
    (
        "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0 "
        "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied "
        "see the license for the specific language governing permissions and limitations under the license",
        "apache-2",
    ),
    ("this work is licensed under the gnu general public license version 3", "gpl-3"),
    ("this work is licensed under the gnu general public license version 2", "gpl-2"),
    ("you can redistribute it and or modify it under the terms of the gnu general", "gpl"),
    ("you can redistribute it and or modify it under the terms of the gnu lesser", "lgpl"),
    ("you can redistribute it and or modify it under the terms of the gnu affero", "agpl"),
    ("distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu general", "gpl"),
    ("distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu lesser", "lgpl"),
    ("distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu affero", "agpl"),
    ("under the terms of the gnu lesser general public license", "lgpl"),
    ("under the terms of the gnu affero general public license", "agpl"),
    ("redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "bsd"),
    (BSD_HEAD + BSD_TAIL, "bsd-2"),
    (BSD_HEAD + BSD_NAME + BSD_TAIL, "bsd-3"),
    ("permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "isc"),
    (
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies "
        "the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness "
        "in no event shall the author be liable for any special direct indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits "
        "whether in an action of contract negligence or other tortious action arising out of or in connection with the use or performance of this software",
        "isc",
    ),
    ("this source code form is subject to the terms of the mozilla public license v 2 0", "mpl-2"),
    ("this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at https mozilla org mpl 2 0", "mpl-2"),
    (
        "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software "
        "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions",
        "zlib",
    ),
    (
        "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license the software "
        "to use reproduce display distribute execute and transmit the software and to prepare derivative works of the software and to permit third parties to whom the software is furnished to do so",
        "bsl-1",
    ),
    ("licensed under cc by nc 4 0", "cc-by-nc"),
    ("licensed under cc by sa 4 0", "cc-by-sa"),
    ("licensed under cc by 4 0", "cc-by"),
    ("this work is licensed under a creative commons attribution noncommercial 4 0 international license", "cc-by-nc"),
    ("this work is licensed under a creative commons attribution 4 0 international license", "cc-by"),
    ("this is free and unencumbered software released into the public domain", "unlicense"),
)


def templates(spark: SparkSession) -> DataFrame:
    """(tmpl, base, label, grams, tpos, tgram, thash): one row per template gram."""
    rows = [(i, base, label, text.split()) for i, (text, label, base) in enumerate([(p, lab, True) for p, lab in PHRASES.items()] + [(t, lab, False) for t, lab in TEMPLATES])]
    flat = [(i, base, label, len(w) - K + 1, j, " ".join(w[j : j + K])) for i, base, label, w in rows for j in range(len(w) - K + 1)]
    return spark.createDataFrame(flat, "tmpl int, base boolean, label string, grams int, tpos int, tgram string").withColumn("thash", F.xxhash64("tgram"))


def words(text: Column) -> Column:
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), BREAK, -1), "")


def _blocks(w: Column) -> Column:
    """A text's words in blocks of BLOCK grams, each with the place of its first word; a text without words has an empty one."""
    last = F.greatest(F.lit(0), F.floor((F.size(w) - K) / BLOCK)).cast("int")
    return F.transform(F.sequence(F.lit(0), last), lambda j: F.struct((j * BLOCK).alias("at"), F.slice(w, j * BLOCK + 1, F.lit(BLOCK + K - 1)).alias("w")))


def _grams(at: Column, w: Column) -> Column:
    """A block's grams with their places, and in a text's first block a row (-1, null) for the text itself."""
    gram = lambda i: F.struct((at + i).alias("dpos"), F.concat_ws(" ", F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)).alias("gram"))
    none = F.array().cast("array<struct<dpos:int,gram:string>>")
    row = F.when(at == 0, F.array(F.struct(F.lit(-1).alias("dpos"), F.lit(None).cast("string").alias("gram")))).otherwise(none)
    return F.concat(row, F.when(F.size(w) >= K, F.transform(F.sequence(F.lit(0), F.size(w) - K), gram)).otherwise(none))


def votes(docs: DataFrame) -> DataFrame:
    """Hits of all rolling grams by diagonal, and a row (tmpl null) for each document itself.

    (doc_id, th, n_words, tmpl, base, label, grams, diag, covered, copies)
    """
    d = docs.select("doc_id", F.xxhash64("text").alias("th"), words(F.col("text")).alias("w"))
    d = d.select("doc_id", "th", "w", F.size("w").cast("bigint").alias("n_words"))
    d = d.select("doc_id", "th", "n_words", F.explode(_blocks(F.col("w"))).alias("b"))
    d = d.select("doc_id", "th", "n_words", F.explode(_grams(F.col("b.at"), F.col("b.w"))).alias("g"))
    d = d.select("doc_id", "th", "n_words", "g.dpos", "g.gram").withColumn("h", F.xxhash64("gram"))
    hit = d.join(F.broadcast(templates(docs.sparkSession)), (F.col("h") == F.col("thash")) & (F.col("gram") == F.col("tgram")), "left")
    hit = hit.where(F.col("tmpl").isNotNull() | (F.col("dpos") == -1))
    return hit.groupBy("doc_id", "th", "n_words", "tmpl", "base", "label", "grams", (F.col("dpos") - F.col("tpos")).alias("diag")).agg(
        F.collect_set("tpos").alias("covered"), F.count(F.lit(1)).alias("copies")
    )


def spans(docs: DataFrame) -> DataFrame:
    """Verified spans, and the row of each document: (doc_id, th, n_words, tmpl, base, label, start, cover, copies).

    A phrase's place is a diagonal with all of its grams; other templates'
    neighbouring diagonals are merged before their cover is taken.
    """
    v = votes(docs)
    by = Window.partitionBy("doc_id", "th", "tmpl").orderBy("diag")
    v = v.withColumn("new", F.coalesce((F.col("diag") - F.lag("diag").over(by) > NEAR) | F.col("base"), F.lit(True)))
    v = v.withColumn("span", F.sum(F.col("new").cast("int")).over(by))
    merged = v.groupBy("doc_id", "th", "n_words", "tmpl", "base", "label", "grams", "span").agg(
        F.min("diag").alias("start"), F.array_distinct(F.flatten(F.collect_list("covered"))).alias("covered"), F.max("copies").alias("copies")
    )
    last = F.array_contains("covered", F.col("grams") - 1)
    return merged.withColumn("got", F.size("covered")).withColumn("cover", F.col("got") / F.col("grams")).withColumn("ended", F.coalesce(last, F.lit(False)))


def digest(docs: DataFrame) -> DataFrame:
    """The contract's columns for every row."""
    s = spans(docs)
    place = F.col("base") & (F.col("got") == F.col("grams"))
    label = F.when(place | (~F.col("base") & (F.col("cover") >= COVER) & F.col("ended")), F.col("label"))
    found = s.groupBy("doc_id", "th").agg(
        F.max("n_words").alias("n_words"),
        F.count(F.when(place, 1)).alias("n_base"),
        F.min(F.when(place, F.col("start").cast("bigint"))).alias("first_word"),
        F.max(F.when(place, F.col("start").cast("bigint"))).alias("last_word"),
        F.concat_ws(",", F.array_sort(F.collect_set(F.when(place, F.col("label"))))).alias("base_labels"),
        F.concat_ws(",", F.array_sort(F.collect_set(label))).alias("labels"),
        F.coalesce(F.max("cover"), F.lit(0.0)).alias("score"),
        F.max(F.when(F.col("tmpl").isNull(), F.col("copies"))).alias("copies"),
    )
    # repeated rows share their key: each comes back
    many = found.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("bigint"), "copies")))
    return many.select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")
