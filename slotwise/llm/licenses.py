"""Licence scans: TF-IDF cosine to templates, then inheritance from the nearest directory.

Whole texts and windows of joined lines and sentences are sparse TF-IDF vectors;
their cosine to notices and to whole licences names the licence of a header, or
makes the text a licence file.  Templates that a text's words can't bring to
the least cosine, and windows without those words that a template can't do
without, are passed over, which loses nothing.  An SPDX tag names a licence
outright.  A text without either inherits from the nearest directory above it
that has a licence file, found by joins of directories with their ancestors.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slotwise.llm.common import Workspace, parted, read, slices, words_of
from slotwise.llm.license_texts import BODIES

# Notices by which licences are named, and the opening of their texts.
TEMPLATES = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the software without restriction"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0; you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or any later version."),
    ("GPL-2.0", "Licensed under the GNU General Public License, version 2."),
    ("LGPL-3.0", "Licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "Licensed under the GNU Affero General Public License, version 3."),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related rights to this work."),
    ("proprietary", "All rights reserved."),
)
SENTENCE = re.compile(r"(?<=[.!?;])\s+")
LEAST = 0.75
#: A licence file is hardly anything but a licence.
LEAST_FILE = 0.9
#: A longer sentence, or line without a sentence end, is cut into parts of PART words for windows to join.
LONGEST_SENTENCE, PART = 6, 2
#: Marks of comments before a line's own text.
MARKS = re.compile(r"^(?:\s|[^\w\s]|(?:dnl|rem)\b)+", re.IGNORECASE)
_ID = r"\(*[A-Za-z0-9][A-Za-z0-9.+-]*\)*"
_EXPRESSION = rf"({_ID}(?:[ \t]+(?:AND|OR|WITH)[ \t]+{_ID})*)"
SPDX = re.compile(rf"SPDX-License-Identifier:[ \t]*{_EXPRESSION}", re.IGNORECASE)
#: A field of a manifest, taken only where it names licences that have templates.
FIELD = re.compile(rf"""\blicen[cs]e["']?[ \t]*[:=][ \t]*["']?{_EXPRESSION}""", re.IGNORECASE)
NAMES = {n.lower(): n for n in [*(n for n, _ in TEMPLATES), *BODIES] if n != "proprietary"}
OPERATORS = ("AND", "OR", "WITH")


def declared(text: str) -> str | None:
    """The first licence, or expression of licences, that a tag or a field names."""
    for pattern, any_name in ((SPDX, True), (FIELD, False)):
        for m in pattern.finditer(text):
            ids = re.sub(r"([()])", r" \1 ", m[1]).split()
            own = [re.sub(r"(?:-only|-or-later|\+)$", "", x.rstrip(".-"), flags=re.IGNORECASE) for x in ids]
            own = [x.upper() if x.upper() in OPERATORS else NAMES.get(x.lower(), x) for x in own if x]
            names = [x for x in own if x not in (*OPERATORS, "(", ")")]
            if names and (all(x in NAMES.values() for x in names) or any_name and not {x.upper() for x in names} & {"NONE", "NOASSERTION"}):
                return " ".join(own).replace("( ", "(").replace(" )", ")")
    return None


def document_frequencies(docs: DataFrame, vocabulary: list[str]) -> tuple[int, dict[str, int]]:
    """(documents, documents with each word); what reaches the driver is bounded by the templates' words."""
    known = frozenset(vocabulary)

    def run(batches):
        n, seen = 0, Counter()
        for _, texts in slices(batches, 0):
            for t in texts:
                n += 1
                own: set[str] = set()
                for part in parted(t or ""):
                    own |= known.intersection(words_of(part))
                seen.update(own)
        rows = [("", n), *sorted(seen.items())]
        yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in rows]), pa.array([k for _, k in rows], pa.int64())], ["word", "n"])

    got = dict(docs.select("text").mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).collect())
    return got.pop("", 0), got


class Templates:
    """Texts of known licences as vectors; words of none of them weigh most."""

    def __init__(self, texts, n: int, df: dict[str, int]):
        own = [(name, words_of(t)) for name, t in texts]
        self.idf = {w: math.log((1 + n) / (1 + df.get(w, 0))) + 1 for w in {w for _, words in own for w in words}}
        self.other = math.log(1 + n) + 1
        self.names, self.sizes = [name for name, _ in own], [len(words) for _, words in own]
        self.vectors = [self.vector(words) for _, words in own]
        self.by_word: dict[str, list[int]] = {}
        for i, v in enumerate(self.vectors):
            for w in v:
                self.by_word.setdefault(w, []).append(i)
        self.anchors = [self.needed(v) for v in self.vectors]

    @staticmethod
    def needed(v: dict[str, float]) -> frozenset[str]:
        """Words of a template of which any text of cosine LEAST has one: the others' part is shorter than that."""
        rest, out = 1.0, set()
        for w in sorted(v, key=lambda w: (-v[w], w)):
            if rest < LEAST * LEAST - 1e-9:
                break
            rest -= v[w] ** 2
            out.add(w)
        return frozenset(out)

    def vector(self, words: list[str]) -> dict[str, float]:
        raw = {w: k * self.idf.get(w, self.other) for w, k in Counter(words).items()}
        norm = math.sqrt(sum(x * x for x in raw.values()))
        return {w: x / norm for w, x in raw.items()}

    def best(self, words: list[str], among: list[int]) -> tuple[float, str | None]:
        """Of the given templates the one of the highest cosine; ties go to the first."""
        if not among or not words:
            return 0.0, None
        v = self.vector(words)
        dots = {i: sum(x * v.get(w, 0.0) for w, x in self.vectors[i].items()) for i in among}
        top = max(among, key=lambda i: (dots[i], -i))
        return dots[top], self.names[top] if dots[top] > 0 else None

    def live(self, words: set[str], least: float) -> list[int]:
        """Templates that some part of the text may reach: no cosine is above the length of a
        template's part on the text's words."""
        square = [0.0] * len(self.vectors)
        for w in self.by_word.keys() & words:
            for i in self.by_word[w]:
                square[i] += self.vectors[i][w] ** 2
        return [i for i, x in enumerate(square) if x >= least * least - 1e-9]

    def windows(self, lines: list[list[str]], live: list[int]):
        """(cosine, licence) of the best of the live templates for each window of joined lines with a word that one needs."""
        most = 2 * max(self.sizes[i] for i in live)
        needed = frozenset().union(*(self.anchors[i] for i in live))
        mentions = [not needed.isdisjoint(line) for line in lines]
        near, ahead = [False] * len(lines), most + 1  # a mention is in reach
        for s in range(len(lines) - 1, -1, -1):
            ahead = 0 if mentions[s] else ahead + len(lines[s])
            near[s] = ahead <= most
        for s in range(len(lines)):
            if not near[s] or not lines[s]:
                continue
            words: list[str] = []
            seen, square, counts, dots = False, 0.0, Counter(), dict.fromkeys(live, 0.0)
            for e in range(s, len(lines)):
                if len(words) + len(lines[e]) > most:
                    break
                words += lines[e]
                seen |= mentions[e]
                for w in lines[e]:
                    x = self.idf.get(w, self.other)
                    square += x * x * (2 * counts[w] + 1)
                    counts[w] += 1
                    for i in self.by_word.get(w, ()):
                        if i in dots:
                            dots[i] += x * self.vectors[i][w]
                if seen and lines[e]:
                    top = max(live, key=lambda i: (dots[i], -i))
                    yield dots[top] / math.sqrt(square), self.names[top]

    def sliding(self, lines: list[list[str]], i: int) -> float:
        """The highest cosine of a template to windows of about its own size."""
        t, best = self.vectors[i], 0.0
        dot, square, held, s, counts = 0.0, 0.0, 0, 0, Counter()
        for line in lines:
            for w in line:
                x = self.idf.get(w, self.other)
                square += x * x * (2 * counts[w] + 1)
                counts[w] += 1
                dot += x * t.get(w, 0.0)
            held += len(line)
            while held - len(lines[s]) >= self.sizes[i]:
                for w in lines[s]:
                    x = self.idf.get(w, self.other)
                    counts[w] -= 1
                    square -= x * x * (2 * counts[w] + 1)
                    dot -= x * t.get(w, 0.0)
                held -= len(lines[s])
                s += 1
            if 2 * held >= self.sizes[i]:
                best = max(best, dot / math.sqrt(square))
        return best


class Matcher:
    def __init__(self, n: int, df: dict[str, int]):
        self.notices, self.bodies = Templates(TEMPLATES, n, df), Templates(BODIES.items(), n, df)

    def scan(self, text: str | None) -> tuple[str, float, str | None]:
        """('file', 'header' or 'none', cosine, licence) of one text; without a licence the cosine is 0."""
        text = text or ""
        every: set[str] = set()
        for part in parted(text):
            every.update(words_of(part))
        bodies, notices = self.bodies.live(every, LEAST_FILE), self.notices.live(every, LEAST)
        named = declared(text)
        if not (bodies or notices or named):
            return "none", 0.0, None
        words = words_of(text)
        whole = max(self.notices.best(words, notices), self.bodies.best(words, bodies), key=lambda x: x[0])
        if whole[0] >= LEAST_FILE:
            return "file", *whole
        if named:
            return "header", 1.0, named
        lines = list(units(text))
        # a whole licence says more than a notice in it
        found = max(((self.bodies.sliding(lines, i), self.bodies.names[i]) for i in bodies), key=lambda x: x[0], default=(0.0, None))
        if found[0] >= LEAST_FILE:
            return "header", *found
        scored = self.notices.windows(lines, notices) if notices else ()
        # reserved rights stand beside licences
        found = max(scored, key=lambda x: (x[0] >= LEAST and x[1] != "proprietary", x[0]), default=(0.0, None))
        return ("header", *found) if found[0] >= LEAST else ("none", 0.0, None)


def units(text: str):
    """The words of lines without comment marks, by sentences; longer ones in parts."""
    for line in text.split("\n"):
        for sentence in SENTENCE.split(MARKS.sub("", line)):
            words = words_of(sentence)
            step = len(words) if len(words) <= LONGEST_SENTENCE else PART
            for i in range(0, len(words), step or 1):
                yield words[i : i + step]


def ancestors(path):
    """The directories above a path, from the nearest; '' is the root."""
    parts = F.slice(F.split(path, "/"), 1, F.size(F.split(path, "/")) - 1)
    return F.transform(F.sequence(F.size(parts), F.lit(0), F.lit(-1)), lambda k: F.array_join(F.slice(parts, 1, k), "/"))


def license_scan(files: DataFrame) -> DataFrame:
    """(id, license, basis, score, directory) of files (id, path, text).

    basis: 'file', 'header', 'inherited' (directory: from where) or 'none'.
    Of several licence files in a directory the highest cosine counts, then the
    first licence by name; of several windows of one cosine the first, of
    several templates the first.  Null and empty texts have no licence of their
    own but may inherit; a null path inherits nothing; repeated rows stay; an
    empty table gives no rows; other columns are not read.
    """
    files = files.select("id", "path", "text")
    n, df = document_frequencies(files, sorted({w for _, t in (*TEMPLATES, *BODIES.items()) for w in words_of(t)}))

    def run(batches):
        m = Matcher(n, df)
        for b, texts in slices(batches, 2):
            found = [m.scan(t) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64()), pa.array([f[2] for f in found], pa.string())],
                ["id", "path", "basis", "score", "license"])

    kind = files.schema["id"].dataType.simpleString()
    scanned = files.mapInArrow(run, f"id {kind}, path string, basis string, score double, license string")
    # read three times below
    scanned = Workspace(files.sparkSession, "licenses").put(scanned.withColumn("_dir", F.element_at(ancestors(F.col("path")), 1)), "scanned")
    licensed = scanned.where("basis = 'file' and _dir is not null").groupBy("_dir").agg(F.min(F.struct((-F.col("score")).alias("s"), "license")).alias("m")).select(F.col("_dir").alias("directory"), F.col("m.license").alias("_license"))
    # a row for each directory, not for each file
    dirs = scanned.where("basis = 'none' and _dir is not null").select("_dir").distinct()
    above = dirs.select("_dir", F.posexplode(ancestors(F.concat("_dir", F.lit("/")))).alias("_far", "directory"))
    near = above.join(licensed, "directory").groupBy("_dir").agg(F.min(F.struct("_far", "directory", "_license")).alias("m"))
    near = near.select(F.col("_dir").alias("_from"), "m.directory", "m._license")
    out = scanned.join(near, (F.col("_dir") == F.col("_from")) & (F.col("basis") == "none"), "left")
    inherits = F.col("_license").isNotNull()
    return out.select("id", F.coalesce("license", "_license").alias("license"), F.when(inherits, "inherited").otherwise(F.col("basis")).alias("basis"), "score", "directory")


def op6_license_scan(spark, sf_dir):
    docs = read(spark, sf_dir, "documents")
    files = docs.select(F.col("doc_id").alias("id"), F.concat_ws("/", "source", "lang", "doc_id").alias("path"), "text")
    return license_scan(files).withColumnRenamed("id", "doc_id")
