"""License scan over a positional rare-token index.

The index is built from licence texts and notices (``TEMPLATES``). Each names mandatory key phrases, and the words of
these are its candidates: of them the ``ANCHORS`` with the highest IDF over the corpus, counted over all its documents,
become the template's anchors and get postings (template, position). A file looks its anchor words up; each hit at file
position p of a word that stands at q in a template proposes that the template starts at p - q. The postings of a
template are intersected by relative position: a start is kept if every anchor proposes it. Proposals are packed into
longs, and equal ones are neighbours once sorted, so a text full of licence words costs n log n. A start that is kept
is verified by the template's mandatory key phrases, each of which must stand at its own offset. The base phrases are
templates of their own whose key phrase is the whole phrase, so every place of a phrase is proposed.

Anchors are words of key phrases, so the IDF decides how many proposals are looked at and never what is found.

The scan is array expressions: no shuffle, no group, and nothing whose size depends on how often a licence word occurs
in the corpus. The IDF takes a scan of its own before, which shuffles one count per candidate word.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegauge.llm._shared import ascii_lower

# Label, text and mandatory key phrases of public licences and of the notices that name them, as words.
BASE_PHRASES = [("mit", "mit license"), ("apache", "apache license"), ("gpl", "general public license")]
TEMPLATES = [
    ("apache-2.0", "licensed under the apache license version 2 0", ["apache license", "version 2 0"]),
    ("mit-release", "released under the mit license", ["released", "mit license"]),
    ("gpl-3.0", "licensed under the gnu general public license version 3", ["gnu general public license", "version 3"]),
    ("gpl-2.0", "licensed under the gnu general public license version 2", ["gnu general public license", "version 2"]),
    ("cc-by-nc-4.0", "licensed under cc by nc 4 0", ["cc by nc", "4 0"]),
    ("cc-by-sa-4.0", "licensed under cc by sa 4 0", ["cc by sa", "4 0"]),
    ("mpl-2.0", "subject to the terms of the mozilla public license v 2 0", ["mozilla public license"]),
    (
        "mit-text",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation "
        "files the software to deal in the software without restriction including without limitation the rights to use copy modify "
        "merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is "
        "furnished to do so subject to the following conditions the above copyright notice and this permission notice shall be "
        "included in all copies or substantial portions of the software the software is provided as is without warranty of any kind "
        "express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and "
        "noninfringement in no event shall the authors or copyright holders be liable for any claim damages or other liability "
        "whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or "
        "other dealings in the software",
        ["permission is hereby granted", "free of charge"],
    ),
    (
        "isc-text",
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided "
        "that the above copyright notice and this permission notice appear in all copies the software is provided as is and the author "
        "disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness in no "
        "event shall the author be liable for any special direct indirect or consequential damages or any damages whatsoever resulting "
        "from loss of use data or profits whether in an action of contract negligence or other tortious action arising out of or in "
        "connection with the use or performance of this software",
        ["permission to use copy modify", "with or without fee"],
    ),
    (
        "bsd-text",
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following "
        "conditions are met 1 redistributions of source code must retain the above copyright notice this list of conditions and the "
        "following disclaimer 2 redistributions in binary form must reproduce the above copyright notice this list of conditions and "
        "the following disclaimer in the documentation and or other materials provided with the distribution",
        ["redistribution and use", "source and binary forms"],
    ),
    (
        "zlib-text",
        "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any "
        "damages arising from the use of this software permission is granted to anyone to use this software for any purpose including "
        "commercial applications and to alter it and redistribute it freely subject to the following restrictions",
        ["held liable for any damages", "granted to anyone"],
    ),
    (
        "unlicense-text",
        "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell "
        "or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial "
        "and by any means",
        ["free and unencumbered software", "public domain"],
    ),
    (
        "apache-notice",
        "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you "
        "may obtain a copy of the license at http www apache org licenses license 2 0 unless required by applicable law or agreed to in "
        "writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind "
        "either express or implied see the license for the specific language governing permissions and limitations under the license",
        ["apache license version 2 0", "except in compliance with the license"],
    ),
    (
        "gpl-3.0-notice",
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as "
        "published by the free software foundation either version 3 of the license or at your option any later version this program is "
        "distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability "
        "or fitness for a particular purpose see the gnu general public license for more details",
        ["redistribute it and or modify it", "gnu general public license", "version 3 of the license"],
    ),
]
DELIMITERS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
ANCHORS = 3
_NOTICE_BITS = 16


@dataclass(frozen=True)
class Notice:
    number: int
    label: str
    base: bool
    words: tuple[str, ...]
    must: tuple[int, ...]  # positions of the words of key phrases
    anchors: tuple[int, ...]  # of these, the words that the fewest documents hold


def _key_positions(words: list[str], phrases: list[str]) -> tuple[int, ...]:
    """Positions of the words of ``phrases``, each at its first place in ``words``."""
    out: set[int] = set()
    for phrase in phrases:
        key = phrase.split()
        at = next(i for i in range(len(words)) if words[i : i + len(key)] == key)
        out.update(range(at, at + len(key)))
    return tuple(sorted(out))


def build_index(held: dict[str, int] | None = None, base=BASE_PHRASES, templates=TEMPLATES) -> list[Notice]:
    """The templates with their anchors: of the words of its key phrases the ``ANCHORS`` with the highest IDF, those
    that the fewest documents hold, the first on ties. ``held`` has the number of documents with a word, 0 if absent."""
    held = held or {}
    texts = [(label, text.split(), True, [text]) for label, text in base]
    texts += [(label, text.split(), False, phrases) for label, text, phrases in templates]
    out = []
    for number, (label, words, is_base, phrases) in enumerate(texts):
        must = _key_positions(words, phrases)
        anchors = tuple(sorted(sorted(must, key=lambda i: (held.get(words[i], 0), i))[:ANCHORS]))
        out.append(Notice(number, label, is_base, tuple(words), must, anchors))
    return out


def document_counts(docs: DataFrame) -> dict[str, int]:
    """For each word of a key phrase, how many of all documents hold it; letters beyond A-Z that fold to a-z count as
    these. One row a word reaches the driver, a number that the templates set and the corpus does not."""
    candidates = sorted({n.words[i] for n in build_index() for i in n.must})
    words = F.split(F.lower("text"), DELIMITERS)
    held = docs.select(F.explode(F.array_intersect(words, F.split(F.lit(" ".join(candidates)), " "))).alias("word"))
    return {r["word"]: r["count"] for r in held.groupBy("word").count().collect()}


def _postings(index: list[Notice]) -> dict[str, list[tuple[int, int]]]:
    out: dict[str, list[tuple[int, int]]] = {}
    for n in index:
        for q in n.anchors:
            out.setdefault(n.words[q], []).append((n.number, q))
    return out


def license_scan(docs: DataFrame, index: list[Notice] | None = None) -> DataFrame:
    """``doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, spans`` per row of
    ``docs(doc_id, text)``; other columns are not read.

    Words are runs of ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]`` after A-Z became a-z; a null text is empty. ``score``
    is the largest share of a notice's words that stand in line at an accepted start, 0 without one.
    ``spans`` lists (label, start, n_words) of everything accepted, sorted. Repeated rows are scanned
    one by one. Without an ``index`` one is built from the counts over ``docs``.
    """
    index = index or build_index(document_counts(docs))
    postings = _postings(index)
    text = F.coalesce("text", F.lit(""))
    split = F.split(text, DELIMITERS)
    staged = (
        docs.select("doc_id", split.alias("ws"))
        # split leaves an empty word before a leading and after a trailing delimiter
        .select("doc_id", "ws", F.when(F.get("ws", F.lit(0)) == "", 1).otherwise(0).alias("lead"))
        .select(
            "doc_id",
            F.col("ws"),
            "lead",
            F.greatest(F.size("ws") - F.col("lead") - F.when(F.element_at("ws", -1) == "", 1).otherwise(0), F.lit(0)).alias("n"),
        )
    )
    # positions of anchor words; lower() is quicker but folds letters beyond A-Z too, so what it finds is looked at again
    anchors = sorted(postings)
    hits = F.filter(
        F.transform(
            "ws",
            lambda w, i: F.when(F.lower(w).isin(anchors) & ascii_lower(w).isin(anchors), F.struct((i - F.col("lead")).alias("p"), F.lower(w).alias("w"))),
        ),
        lambda h: h.isNotNull(),
    )
    posting_map = F.create_map(
        *[x for w, ps in sorted(postings.items()) for x in (F.lit(w), F.array(*[F.struct(F.lit(t).alias("t"), F.lit(q).alias("q")) for t, q in ps]))]
    )
    # a proposal, notice t at start s, is the long s * 2^16 + t
    starts = F.sort_array(
        F.flatten(
            F.transform(
                "hits",
                lambda h: F.transform(posting_map[h["w"]], lambda x: F.shiftleft((h["p"] - x["q"]).cast("long"), _NOTICE_BITS).bitwiseOR(x["t"].cast("long"))),
            )
        )
    )
    found = staged.select("doc_id", "ws", "lead", "n", hits.alias("hits")).select("doc_id", "ws", "lead", "n", starts.alias("all"))
    notice = lambda c: c.bitwiseAND(F.lit((1 << _NOTICE_BITS) - 1)).cast("int")
    needs = F.array(*[F.lit(len(n.anchors)) for n in index])
    # the first of each run of equal proposals, where the run has one of every anchor
    agreed = F.filter(
        "all", lambda c, i: ~F.get("all", i - 1).eqNullSafe(c) & F.get("all", i + F.get(needs, notice(c)) - 1).eqNullSafe(c)
    )
    found = found.select("doc_id", "ws", "lead", "n", agreed.alias("agreed"))
    meta = F.array(
        *[
            F.struct(
                F.lit(n.label).alias("label"),
                F.lit(n.base).alias("base"),
                F.split(F.lit(" ".join(n.words)), " ").alias("words"),
                F.array(*map(F.lit, n.must)).alias("must"),
            )
            for n in index
        ]
    )

    def word(start: Column, i: Column) -> Column:
        """The file's word i of a notice at ``start``; null outside the file."""
        at = start + i
        return F.when((at >= 0) & (at < F.col("n")), ascii_lower(F.get("ws", at + F.col("lead"))))

    def verified(c: Column) -> Column:
        m, start = F.get(meta, notice(c)), F.shiftright(c, _NOTICE_BITS).cast("int")
        phrases = F.forall(m["must"], lambda i: word(start, i).eqNullSafe(F.get(m["words"], i)))
        share = F.size(F.filter(m["words"], lambda w, i: word(start, i).eqNullSafe(w))) / F.size(m["words"])
        return F.when(
            phrases,
            F.struct(m["label"].alias("label"), start.alias("start"), F.size(m["words"]).alias("n_words"), m["base"].alias("base"), share.alias("share")),
        )

    accepted = F.filter(F.transform("agreed", verified), lambda a: a.isNotNull())
    found = found.select("doc_id", "n", F.when(F.size("agreed") > 0, accepted).alias("hit")).select(
        "doc_id", "n", F.coalesce("hit", F.expr("filter(array(), x -> false)").cast("array<struct<label:string,start:int,n_words:int,base:boolean,share:double>>")).alias("hit")
    )
    base = F.filter("hit", lambda a: a["base"])
    join_labels = lambda a: F.array_join(F.array_sort(F.array_distinct(F.transform(a, lambda x: x["label"]))), ",")
    return found.select("doc_id", "n", "hit", base.alias("b")).select(
        "doc_id",
        F.col("n").cast("long").alias("n_words"),
        F.size("b").cast("long").alias("n_base"),
        F.array_min(F.transform("b", lambda x: x["start"])).cast("long").alias("first_word"),
        F.array_max(F.transform("b", lambda x: x["start"])).cast("long").alias("last_word"),
        join_labels(F.col("b")).alias("base_labels"),
        join_labels(F.col("hit")).alias("labels"),
        F.round(F.coalesce(F.array_max(F.transform("hit", lambda x: x["share"])), F.lit(0.0)), 6).alias("score"),
        F.array_sort(F.transform("hit", lambda x: F.struct(x["label"].alias("label"), x["start"].alias("start"), x["n_words"].alias("n_words")))).alias("spans"),
    )


def words_of(text: str | None) -> list[str]:
    """The words of a text, for brute-force checks."""
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)
