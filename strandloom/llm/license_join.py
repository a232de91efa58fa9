"""License scans: exact set-similarity join of text blocks with license templates.

Blocks start every ``step`` words and are twice as long, with a step of STEP words or of the longest template where that is longer, so any passage of a
template's length lies in one. A block
meets a template when it holds at least THRESHOLD of the template's distinct words. Words are ordered by their document
frequency over the whole corpus, rarest first. Filters before the exact overlap:
prefix (a meeting block holds one of the template's first n - need + 1 words), length (it has at least
``need`` distinct words) and position (what follows the first common word, on either side, can still reach ``need``).
The templates are a fixed list, so sending them to every task is bounded.

All templates that meet a block name it. Only of near-identical ones (gpl-2 and gpl-3, the cc-by family) the less contained one is left
out: where another is contained more and the block holds fewer than half of the words that the former has beyond the latter.

Base labels are phrases whose words stand consecutively. Defined results: null text is empty text and gives a row
with no labels and score 0; repeated rows give repeated results; other columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import shared
THRESHOLD = 0.8
STEP = 48

# Phrases of the contract and their labels.
PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}

# Opening or naming passages of public licenses; whole bodies can be given to license_scan.
TEMPLATES = {
    "mit": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files to deal in the software without restriction",
    "apache-2": "licensed under the apache license version 2 0 you may not use this file except in compliance with the license",
    "bsd": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "gpl-3": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license version 3",
    "gpl-3-name": "this work is licensed under the gnu general public license version 3",
    "gpl-2": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license version 2",
    "lgpl": "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license",
    "mpl-2": "this source code form is subject to the terms of the mozilla public license v 2 0",
    "cc-by-4": "this work is licensed under a creative commons attribution 4 0 international license",
    "cc-by-nc-4": "this work is licensed under a creative commons attribution noncommercial 4 0 international license",
    "cc-by-sa-4": "this work is licensed under a creative commons attribution sharealike 4 0 international license",
    "cc0": "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work",
    "isc": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted",
    "unlicense": "this is free and unencumbered software released into the public domain",
    "all-rights-reserved": "no part of this publication may be reproduced or transmitted in any form without the prior written permission of the publisher all rights reserved",
}
#: Names of further passages of a license that has its own label.
ALIASES = {"gpl-3-name": "gpl-3", "cc-by-nc-4": "cc-by-nc"}

#: For bytes.translate: letters lower-cased, digits and bytes over 0x7F kept, the rest made spaces.
WORD_BYTES = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def words_of(data: bytes) -> list[bytes]:
    return data.translate(WORD_BYTES).split()


def phrase_places(joined: bytes, phrase: bytes) -> list[int]:
    """Word indices where phrase starts in space-framed, space-joined words."""
    framed, out, at, words, seen = b" " + phrase + b" ", [], 0, 0, 0
    while (at := joined.find(framed, at)) >= 0:
        words += joined.count(b" ", seen, at)
        seen = at
        out.append(words)
        at += 1
    return out


def document_frequency(docs: DataFrame, text_col: str, vocabulary: set[bytes]) -> dict[bytes, int]:
    """Documents of the whole corpus that hold each word of the (bounded) template vocabulary."""

    def counted(batches):
        seen: Counter = Counter()
        for b in batches:
            for data in b.column(0).cast(pa.binary()).to_pylist():
                seen.update(vocabulary.intersection(words_of(data)))
        yield pa.RecordBatch.from_arrays([pa.array([w.decode() for w in seen], pa.string()), pa.array(list(seen.values()), pa.int64())], names=["w", "n"])

    rows = docs.select(F.coalesce(F.col(text_col), F.lit("")).alias("t")).mapInArrow(counted, "w string, n long").groupBy("w").agg(F.sum("n").alias("n")).collect()
    return {r["w"].encode(): r["n"] for r in rows}


class Join:
    """The templates, ordered by global word frequency, with their prefixes."""

    def __init__(self, templates: dict[str, str], frequency: dict[bytes, int], threshold: float):
        self.order = {w: i for i, w in enumerate(sorted({w for t in templates.values() for w in t.encode().split()}, key=lambda w: (frequency.get(w, 0), w)))}
        self.templates, self.prefix = [], {}
        self.own = {name: set(text.encode().split()) for name, text in templates.items()}
        self.step = max(STEP, *(len(text.split()) for text in templates.values()))
        for k, (name, text) in enumerate(templates.items()):
            words = sorted(set(text.encode().split()), key=self.order.__getitem__)
            need = math.ceil(threshold * len(words) - 1e-9)
            self.templates.append((name, words, need))
            for i, w in enumerate(words[: len(words) - need + 1]):
                self.prefix.setdefault(w, []).append((k, i))

    def blocks(self, words: list[bytes]):
        """(template, first word, end, containment) of every block that meets a template."""
        prefix = self.prefix
        if prefix.keys().isdisjoint(words):
            return
        step = self.step
        starts = sorted({s for i, w in enumerate(words) if w in prefix for s in (i // step * step, i // step * step - step) if s >= 0})
        for s in starts:
            distinct = set(words[s : s + 2 * step])
            known = sorted((w for w in distinct if w in self.order), key=self.order.__getitem__)
            tried = set()
            for j, w in enumerate(known):
                for k, i in prefix.get(w, ()):
                    if k in tried:
                        continue
                    tried.add(k)
                    name, own, need = self.templates[k]
                    if len(known) < need or min(len(own) - i, len(known) - j) < need:
                        continue
                    common = len(distinct.intersection(own))
                    if common >= need:
                        yield name, s, min(s + 2 * step, len(words)), common / len(own)

    def named(self, words: list[bytes], meets: list[tuple]) -> set[str]:
        """Templates that name their blocks: all that meet one but those whose words are there for a better held one, of equally held ones a larger one."""
        by: dict[int, list] = {}
        for m in meets:
            by.setdefault(m[1], []).append(m)
        out = set()
        for s, group in by.items():
            distinct = set(words[s : group[0][2]]) if len(group) > 1 else set()
            for name, _, _, c in group:
                for better in (n for n, _, _, x in group if (x, len(self.own[n])) > (c, len(self.own[name]))):
                    beyond = self.own[name] - self.own[better]
                    present = len(beyond & distinct)
                    if not present or 2 * present < len(beyond):
                        break
                else:
                    out.add(name)
        return out


def license_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: dict[str, str] | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """For each row: words, base phrase places, labels, best containment, and the meeting blocks."""
    templates = templates or TEMPLATES
    shared.bound_batches(docs.sparkSession)
    vocabulary = {w for t in templates.values() for w in t.encode().split()}
    join = Join(templates, document_frequency(docs, text_col, vocabulary), threshold)
    phrases = {p.encode(): label for p, label in PHRASES.items()}
    fields = [("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64()), ("blocks", pa.list_(pa.struct([("label", pa.string()), ("first", pa.int64()), ("end", pa.int64()), ("containment", pa.float64())])))]

    def one(data: bytes) -> dict:
        words = words_of(data)
        joined = b" " + b" ".join(words) + b" "
        places, base = [], set()
        for phrase, label in phrases.items():
            if found := phrase_places(joined, phrase):
                places += found
                base.add(label)
        meets = list(join.blocks(words))
        blocks = [{"label": ALIASES.get(n, n), "first": s, "end": e, "containment": c} for n, s, e, c in meets]
        score = max([1.0 if base else 0.0, *(b["containment"] for b in blocks)])
        labels = base | {ALIASES.get(n, n) for n in join.named(words, meets)}
        return {"n_words": len(words), "n_base": len(places), "first_word": min(places, default=None), "last_word": max(places, default=None), "base_labels": ",".join(sorted(base)), "labels": ",".join(sorted(labels)), "score": score, "blocks": blocks}

    def run(texts: pa.Array) -> pa.Array:
        return pa.array([one(t.as_py() or b"") for t in texts.cast(pa.binary())], pa.struct(fields))

    kind = "struct<n_words:long,n_base:long,first_word:long,last_word:long,base_labels:string,labels:string,score:double,blocks:array<struct<label:string,first:long,end:long,containment:double>>>"
    found = docs.select(F.col(id_col).alias("doc_id"), F.arrow_udf(run, kind)(F.coalesce(F.col(text_col), F.lit(""))).alias("r"))
    return found.select("doc_id", "r.*")
