"""Licence scans: TF-IDF cosine of notices and licence files to templates, then inheritance by directory.

A file's passages are its header (the first lines) and the surroundings of every line
with a licence word; the whole file is one more passage where it is short. Around every licence word each
window of a template's length is compared with that template, and the whole file, however long, with whole licence
texts (but the CC ones, which aren't here). Passages and templates
are sparse TF-IDF vectors; the inverse document frequencies of the templates'
words are counted over all files. With all_words those of every word in a passage are (as op10 does),
else a word of no template counts as in one file. A
file's licence is the template of highest cosine, if it is high enough and the passage has the
template's version, kind and name too. Where the passage
makes up most of a file, or the file's name says so, it is a licence file, and
speaks for its directory: files without a licence of their own take that of
the nearest directory above them that has one, by joining paths.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterable, Iterator
from importlib import resources
from itertools import accumulate

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemill.llm.common import exact, map_rows, staged

HEADER_LINES, SHORT_WORDS, LEAST, FILE_SHARE = 12, 400, 0.6, 0.5
#: Words whose document frequencies every task has; those of the others are joined.
FREQUENT = 10_000
#: Notices and opening clauses of common licences.
TEMPLATES = {
    "AGPL-3.0": (
        "This work is licensed under the GNU Affero General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007",
    ),
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/ TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION",
    ),
    "BSD-2-Clause": (
        "Licensed under the BSD 2-Clause License.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    ),
    "BSD-3-Clause": (
        "Licensed under the BSD 3-Clause License.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    ),
    "CC-BY-4.0": (
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
        "Licensed under CC BY 4.0.",
    ),
    "CC-BY-NC-4.0": ("This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.", "Licensed under CC BY-NC 4.0."),
    "CC-BY-NC-ND-4.0": ("This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License.", "Licensed under CC BY-NC-ND 4.0."),
    "CC-BY-NC-SA-4.0": ("This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License.", "Licensed under CC BY-NC-SA 4.0."),
    "CC-BY-ND-4.0": ("This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License.", "Licensed under CC BY-ND 4.0."),
    "CC-BY-SA-4.0": ("This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.", "Licensed under CC BY-SA 4.0."),
    "CC0-1.0": ("CC0 1.0 Universal. To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",),
    "GPL-2.0": (
        "This work is licensed under the GNU General Public License, version 2.",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
        "GNU GENERAL PUBLIC LICENSE Version 2, June 1991",
    ),
    "GPL-3.0": (
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007",
    ),
    "ISC": ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",),
    "LGPL-2.1": (
        "This library is licensed under the GNU Lesser General Public License, version 2.1.",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
        "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999",
    ),
    "LGPL-3.0": (
        "This library is licensed under the GNU Lesser General Public License, version 3.",
        "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007",
    ),
    "MIT": (
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction",
    ),
    "MPL-2.0": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "Mozilla Public License Version 2.0"),
    "Proprietary": ("All rights reserved.", "Copyright. All rights reserved. Unauthorized copying of this file, via any medium, is strictly prohibited."),
    "Unlicense": ("This is free and unencumbered software released into the public domain.",),
}
TEMPLATES = {name: forms if name == "Proprietary" else (*forms, f"SPDX-License-Identifier: {name}") for name, forms in TEMPLATES.items()}
#: What says that a licence doesn't hold; passages are looked for in the text without it.
_DENIED = re.compile(r"\b(?:is|are|was|were)(?:n't|\s+not)\s+(?:\w+\s+){0,2}?(?:licensed|released|distributed|available|covered)\b[^.\n]*(?:\.(?=\d)[^.\n]*)*", re.I)
CUE = re.compile(r"licen[cs]e|copyright|all rights reserved|public domain|creative commons|\bCC0\b|permission (?:is|to)|redistribution and use|free software", re.I)
FILE_NAME = r"(?i)(^|/)(licen[cs]e|copying|unlicense|notice)[^/]*$"
#: A cue with anything between its words, as notices are wrapped and commented out.
_WRAPPED = re.compile(CUE.pattern.replace(" ", r"[^a-z0-9]+"), re.I)
#: Licences whose whole texts are in license_texts; AGPL-3.0 is GPL-3.0's text but for its names and section 13. HEAD words hold a text's title.
FULL = {n: n for n in ("Apache-2.0", "BSD-2-Clause", "BSD-3-Clause", "CC0-1.0", "GPL-2.0", "GPL-3.0", "ISC", "LGPL-2.1", "LGPL-3.0", "MIT", "MPL-2.0")} | {"AGPL-3.0": "GPL-3.0"}
HEAD = 60
_TOKEN = re.compile(r"[a-z0-9]+(?:\.[0-9]+)?")


def tokens(text: str) -> list[str]:
    return _TOKEN.findall(text.lower())


FULL_TEXTS = {name: tokens((resources.files("tidemill.llm") / "license_texts" / f"{file}.txt").read_text("utf-8")) for name, file in FULL.items()}
FULL_WORDS = frozenset(t for words in FULL_TEXTS.values() for t in words)
VOCABULARY = frozenset(t for forms in TEMPLATES.values() for form in forms for t in tokens(form))


#: Words that tell licences of one family apart, and names that a form's passage must have too.
_KINDS = {
    "CC": {"nc": "nc", "noncommercial": "nc", "commercial": "nc", "nd": "nd", "noderivatives": "nd", "noderivs": "nd", "derivatives": "nd", "sa": "sa", "sharealike": "sa", "alike": "sa"},
    "GNU": {"affero": "affero", "agpl": "affero", "lesser": "lesser", "lgpl": "lesser", "library general": "library"},
}
_NAMES = ({"mit"}, {"apache"}, {"mozilla"}, {"bsd"}, {"gnu"}, {"cc", "creative"}, {"cc0"}, {"rights"})
_FAMILY = {"CC": "CC", "GPL": "GNU", "LGPL": "GNU", "AGPL": "GNU"}
_OF_NAME = {"AGPL": {"affero"}, "LGPL": {"lesser"}, "NC": {"nc"}, "ND": {"nd"}, "SA": {"sa"}}


def agrees(name: str, form: set[str], words: list[str], of_file: set[str]) -> bool:
    """Whether a passage has the version, the kind and the name that a template of this licence has.

    The clause on endorsement anywhere in the file tells BSD-3-Clause from BSD-2-Clause where the form has no number.
    """
    there = set(words)
    if "spdx" in form and not form <= there:
        return False
    if any(n & form and not n & there for n in _NAMES):
        return False
    parts = name.split("-")
    if parts[0] == "BSD":
        return parts[1] in there if parts[1] in form else ("endorse" in of_file) == (parts[1] == "3")
    version = parts[-1]
    if version[0].isdigit() and parts[0] != "CC0" and there.isdisjoint({version, version.removesuffix(".0")}):
        return False
    if family := _KINDS.get(_FAMILY.get(parts[0], "")):
        pairs = {f"{a} {b}" for a, b in zip(words, words[1:])}
        return {k for w, k in family.items() if w in there or w in pairs} == set().union(*(_OF_NAME.get(x, set()) for x in parts))
    return True


def passages(text: str) -> list[list[str]]:
    """Token lists of the header, of each cue's line and of it with the lines after, and of a short text as a whole."""
    lines = text.split("\n")
    if not CUE.search(text):  # all its notices hold a cue
        return []
    out, whole = [], [tokens(x) if CUE.search(x) else None for x in lines]
    for i, found in enumerate(whole):
        if found:
            out.append(found)
            after = tokens(" ".join(lines[i : i + 4]))
            if len(after) > len(found):
                out.append(after)
    if out:
        head = tokens("\n".join(lines[:HEADER_LINES]))
        out += [head] if len(head) <= SHORT_WORDS else []
        if len(lines) > HEADER_LINES and len(text) < 8 * SHORT_WORDS and len(all_of := tokens(text)) <= SHORT_WORDS:
            out.append(all_of)
    return out


def cues(words: list[str]) -> list[int]:
    """Places of the tokens that a cue begins in."""
    starts = [0, *accumulate(len(w) + 1 for w in words)]
    return sorted({bisect_right(starts, m.start()) - 1 for m in CUE.finditer(" ".join(words))})


class Matcher:
    """Cosines to the templates under document frequencies."""

    def __init__(self, df: dict[str, int], files: int, more: Iterable[tuple[str, int]] = ()):
        self.files = files
        self.more, self.own = self.know(more), {}
        self.idf = {t: math.log((1 + files) / (1 + df.get(t, 0))) + 1 for t in VOCABULARY}
        self.other = math.log((1 + files) / 2) + 1
        self.forms = [(name, *self.vector(tokens(form))) for name in sorted(TEMPLATES) for form in TEMPLATES[name]]
        self.lengths = [len(tokens(form)) for name in sorted(TEMPLATES) for form in TEMPLATES[name]]
        self.full = None

    def know(self, df: Iterable[tuple[str, int]]) -> dict[str, float]:
        """Weights of further words by their document frequencies."""
        return {t: math.log((1 + self.files) / (1 + n)) + 1 for t, n in df}

    def vector(self, words: list[str]) -> tuple[dict[str, float], float]:
        v = {t: (1 + math.log(c)) * (self.idf.get(t) or self.more.get(t) or self.own.get(t, self.other)) for t, c in Counter(words).items()}
        return v, math.sqrt(sum(x * x for x in v.values()))

    def cosine(self, words: list[str], form: dict[str, float], size: float) -> float:
        v, norm = self.vector(words)
        small, large = (v, form) if len(v) < len(form) else (form, v)
        return min(1.0, sum(x * large[t] for t, x in small.items() if t in large) / (norm * size)) if norm and size else 0.0

    def windows(self, words: list[str], least: float) -> Iterator[tuple[str, dict[str, float], float, list[str]]]:
        """Template, cosine and words of every window of a template's length around a cue that has at least that cosine.

        A template is left out at a cue where even a window of just its words that stand nearby would have less.
        """
        at = cues(words)
        for (name, form, size), length in zip(self.forms, self.lengths):
            done = 0
            for c in at:
                first, last = max(0, c - length + 1), min(c, max(0, len(words) - length))
                near = sum(form[t] ** 2 for t in set(words[first : c + length]) if t in form)
                if math.sqrt(near) < (least - 1e-9) * size:
                    continue
                for i in range(max(first, done), last + 1):
                    window = words[i : i + length]
                    if (cosine := self.cosine(window, form, size)) >= least:
                        yield name, form, cosine, window
                done = max(done, last + 1)

    def whole(self, words: list[str], of_file: set[str], least: float) -> tuple[str, float, int] | None:
        """The full licence text that the file as a whole is."""
        if self.full is None:
            self.full = [(name, *self.vector(text)) for name, text in sorted(FULL_TEXTS.items())]
        out = None
        for name, form, size in self.full:
            if agrees(name, set(), words[:HEAD], of_file) and (cosine := self.cosine(words, form, size)) >= least:
                out = _better(out, (name, cosine, len(words)))
        return out

    def best(self, text: str, least: float = LEAST) -> tuple[str | None, float, int]:
        """Licence, cosine and passage length of the best passage; of equal cosines the first name, then the longest passage.

        Only a cosine of at least least to a template that agrees with the passage gives a licence, and Proprietary only where
        no other does; else the name is null and the cosine that of the nearest passage. Windows and the whole text count as
        passages where they give a licence; the length is the file's if its whole text is that of the licence found.
        """
        nearest: tuple[str | None, float, int] = (None, 0.0, 0)
        text = _DENIED.sub(" ", text)
        if not _WRAPPED.search(text):
            return nearest
        found: dict[bool, tuple[str, float, int]] = {}
        all_of = tokens(text)
        of_file = set(all_of)

        def take(name: str, form: dict[str, float], cosine: float, words: list[str]) -> None:
            if agrees(name, set(form), words, of_file):
                found[name == "Proprietary"] = _better(found.get(name == "Proprietary"), (name, cosine, len(words)))

        for words in passages(text):
            v, norm = self.vector(words)
            for name, form, size in self.forms:
                if norm and size:
                    small, large = (v, form) if len(v) < len(form) else (form, v)
                    cosine = min(1.0, sum(x * large[t] for t, x in small.items() if t in large) / (norm * size))
                    if cosine > nearest[1]:
                        nearest = None, cosine, len(words)
                    if cosine >= least:
                        take(name, form, cosine, words)
        for name, form, cosine, words in self.windows(all_of, least):
            take(name, form, cosine, words)
        if full := self.whole(all_of, of_file, least):
            found[False] = best = _better(found.get(False), full)
            if best[0] == full[0]:
                found[False] = *best[:2], full[2]
        return found.get(False) or found.get(True) or nearest


def _better(a: tuple[str, float, int] | None, b: tuple[str, float, int]) -> tuple[str, float, int]:
    """The higher cosine; of equal ones the first name, then the longest passage."""
    if a is None or b[1] > a[1] + 1e-12:
        return b
    return b if abs(b[1] - a[1]) <= 1e-12 and (b[0], -b[2]) < (a[0], -a[2]) else a


def _frequencies():
    def rows(files: Iterable[tuple]) -> Iterator[tuple]:
        df: Counter = Counter()
        for (text,) in files:
            df[""] += 1
            df.update(VOCABULARY.intersection(_TOKEN.findall((text or "").lower())))
        yield from df.items()

    return rows


def _scan(least: float, share: float, model):
    def rows(files: Iterable[tuple]) -> Iterator[tuple]:
        matcher = Matcher(*model)
        for doc_id, path, named, text in files:
            text = text or ""
            name, cosine, size = matcher.best(text, least)
            yield doc_id, path, name, cosine, bool(name) and (bool(named) or size >= share * len(tokens(text)))

    return rows


def _all_frequencies():
    def rows(files: Iterable[tuple]) -> Iterator[tuple]:
        df: Counter = Counter()
        for (text,) in files:
            df[""] += 1
            df.update(set(_TOKEN.findall((text or "").lower())))
            if len(df) > 1 << 18:
                yield from df.items()
                df.clear()
        yield from df.items()

    return rows


def _among(words: frozenset):
    def rows(counted: Iterable[tuple]) -> Iterator[tuple]:
        return (r for r in counted if r[0] in words)

    return rows


def _candidates(known: frozenset):
    def rows(files: Iterable[tuple]) -> Iterator[tuple]:
        for digest, text in files:
            if _WRAPPED.search(text):
                yield digest, text, sorted(set(tokens(text)) - known)

    return rows


def _match(least: float, share: float, model):
    def rows(files: Iterable[tuple]) -> Iterator[tuple]:
        matcher = Matcher(*model)
        for digest, text, words in files:
            matcher.own = matcher.know((w["t"], w["n"]) for w in words or ())
            name, cosine, size = matcher.best(text, least)
            yield digest, name, cosine, bool(name) and size >= share * len(tokens(text))

    return rows


def directory(path):
    """The directory of a path; '' at the top."""
    return F.regexp_replace(path, r"/?[^/]*$", "")


def scan(files: DataFrame, least: float = LEAST, share: float = FILE_SHARE, all_words: bool = True) -> DataFrame:
    """files (doc_id, path, text) as doc_id, path, licence of its own (null if none), similarity, is_licence_file."""
    if all_words:
        return _scan_all_words(files, least, share)
    rows = files.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("path").cast("string").alias("path"), F.col("text").cast("string").alias("text"))
    counts = {r["t"]: int(r["n"]) for r in map_rows(rows.select("text"), _frequencies, "t string, n long").groupBy("t").agg(F.sum("n").alias("n")).collect()}
    total = counts.pop("", 0)  # at most as many counts as the templates have words
    named = F.coalesce(F.col("path").rlike(FILE_NAME), F.lit(False)).alias("named")
    return map_rows(rows.select("doc_id", "path", named, "text"), _scan, "doc_id long, path string, licence string, similarity double, is_licence_file boolean", least, share, (counts, total))


def _scan_all_words(files: DataFrame, least: float, share: float) -> DataFrame:
    """scan with the document frequencies of all words.

    Frequencies of all words are a table; those of the templates' words and of the FREQUENT most frequent ones
    go to every task, those of the other words by a join with the words of the texts that have passages. Equal texts are matched once.
    """
    text = F.col("text").cast("string")
    rows = files.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("path").cast("string").alias("path"), text.alias("text"), F.sha2(text, 256).alias("digest"))
    counts = staged(map_rows(rows.select("text"), _all_frequencies, "t string, n long").groupBy("t").agg(F.sum("n").alias("n")), "licence-words")
    own = VOCABULARY | FULL_WORDS
    known = {r["t"]: int(r["n"]) for r in map_rows(counts.select("t", "n"), _among, "t string, n long", own | {""}).collect()}
    total = known.pop("", 0)
    more = [(t, known.get(t, 0)) for t in sorted(own - VOCABULARY)]
    more += [(r["t"], int(r["n"])) for r in counts.where("t != ''").orderBy(F.desc("n"), "t").limit(FREQUENT).collect()]
    joined = frozenset(t for t, _ in more) | VOCABULARY
    found = map_rows(rows.where("text is not null").select("digest", "text"), _candidates, "digest string, text string, words array<string>", joined)
    found = staged(found.dropDuplicates(["digest"]), "licence-texts")
    rare = found.select("digest", F.explode("words").alias("t")).join(counts, "t").groupBy("digest").agg(F.collect_list(F.struct("t", "n")).alias("words"))
    matched = map_rows(found.select("digest", "text").join(rare, "digest", "left"), _match, "digest string, licence string, similarity double, most boolean", least, share, (known, total, more))
    named = F.coalesce(F.col("path").rlike(FILE_NAME), F.lit(False))
    out = rows.select("doc_id", "path", "digest").join(matched, "digest", "left").select(
        "doc_id", "path", "licence", F.coalesce("similarity", F.lit(0.0)).alias("similarity"), (F.col("licence").isNotNull() & (named | F.coalesce("most", F.lit(False)))).alias("is_licence_file")
    )
    return staged(out, "licence-scan")


def inherited(scanned: DataFrame) -> DataFrame:
    """Adds licence_dir (where the licence comes from) and how: own, inherited or none.

    A directory with several licence files has that of the most files, of equals the
    first name. Ancestors are listed for distinct directories, not for files, so a directory of very
    many files makes no more rows than one of few.
    """
    at = scanned.withColumn("dir", directory(F.col("path")))
    votes = at.where("is_licence_file and dir is not null").groupBy("dir", "licence").agg(F.count("*").alias("n"))
    rank = Window.partitionBy("dir").orderBy(F.desc("n"), "licence")
    spoken = votes.withColumn("r", F.row_number().over(rank)).where("r = 1").select(F.col("dir").alias("above"), F.col("licence").alias("dir_licence"))
    parts = F.split("dir", "/")
    above = F.when(F.col("dir") == "", F.array(F.lit(""))).otherwise(F.transform(F.sequence(F.lit(0), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/")))
    ancestors = at.where("dir is not null").select("dir").distinct().withColumn("above", F.explode(above))
    nearest = ancestors.join(spoken, "above").groupBy("dir").agg(F.max(F.struct(F.length("above").alias("n"), "above", "dir_licence")).alias("near"))
    out = at.join(nearest, "dir", "left")
    own = F.col("licence").isNotNull()
    return out.select(
        "doc_id", "path", F.coalesce("licence", F.col("near.dir_licence")).alias("licence"), "similarity", "is_licence_file",
        F.when(own, F.lit("own")).when(F.col("near.above").isNotNull(), F.lit("inherited")).otherwise("none").alias("how"),
        F.when(own, F.col("dir")).otherwise(F.col("near.above")).alias("licence_dir"),
    )


def license_scan(files: DataFrame, least: float = LEAST, share: float = FILE_SHARE, all_words: bool = True) -> DataFrame:
    """One row per file (doc_id, path, text): its licence and where it comes from.

    A null text is empty and has no licence of its own; a null path has no
    directory and inherits nothing. Repeated rows are files of their own. An empty table gives no rows. A very long text is
    scanned whole in one task. Other columns are left behind.
    """
    return inherited(scan(exact(files), least, share, all_words))


def documents_as_files(docs: DataFrame) -> DataFrame:
    """Documents at source/language/doc_id; a null source or language is left out of the path."""
    docs = exact(docs)
    return docs.select("doc_id", F.concat_ws("/", F.col("source").cast("string"), F.col("lang").cast("string"), F.coalesce(F.col("doc_id").cast("string"), F.lit("-"))).alias("path"), "text")
