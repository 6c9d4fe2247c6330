"""Licence scans: sparse TF-IDF cosine of headers and licence files to templates, then inheritance from the nearest directory.

Templates are whole licence texts (the files of ``templates/``) and short notices. A text that speaks of licences is
compared at ever finer levels: whole, runs of paragraphs, paragraphs, lines, sentences; comment marks don't count, so a
header wrapped in a comment is one paragraph. What is near enough to its template isn't looked into further. Words that
no template has count with the largest weight, so other prose lowers the cosine. A file whose words are mostly licence
text, or that is named as such, licenses its directory; files without a licence of their own take that of the nearest
directory above them, by joins on directory paths.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from importlib import resources

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written

#: Cosine from which a piece of text is a licence, from which it isn't looked into further, and the share of a file's
#: words from which it is a licence file.
LEAST, SURE, MOSTLY = 0.6, 0.85, 0.5

# Notices by licence identifier.
NOTICES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction"),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products"),
    ("BSD-3-Clause", "SPDX-License-Identifier: BSD-3-Clause"),
    ("BSD-2-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("BSD-2-Clause", "SPDX-License-Identifier: BSD-2-Clause"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License"),
    ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0-only"),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-2.0", "SPDX-License-Identifier: GPL-2.0-only"),
    ("LGPL-3.0", "This library is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "Licensed under the GNU Affero General Public License, version 3."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related rights to this work. CC0 1.0 public domain dedication"),
    ("Unlicense", "This is free and unencumbered software released into the public domain"),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("LGPL-2.1", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."),
    ("LGPL-3.0", "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("AGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("AGPL-3.0", "SPDX-License-Identifier: AGPL-3.0-only"),
    ("LGPL-2.1", "SPDX-License-Identifier: LGPL-2.1-only"),
    ("LGPL-3.0", "SPDX-License-Identifier: LGPL-3.0-only"),
    ("MPL-2.0", "SPDX-License-Identifier: MPL-2.0"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("ISC", "SPDX-License-Identifier: ISC"),
    ("Proprietary", "All rights reserved."),
    ("Proprietary", "All rights reserved. Unauthorized copying of this file is strictly prohibited. Proprietary and confidential"),
)
#: Words of which a paragraph has one if it may be part of a licence, and words that a run of such paragraphs may go on with.
TRIGGERS = ("licens", "licenc", "spdx", "permission", "redistribut", "public domain", "all rights reserved", "copyright", "creative commons")
LEGAL = (*TRIGGERS, "warrant", "liab", "condition", "provided", "contributor", "http:", "https:", "the software", "the work", "free software foundation", "as is")
NAMED = r"(?i)(^|/)(licen[cs]e|copying|notice|unlicense)([._-][^/]*)?$"

_WORD = re.compile(r"[^\W_]+(?:\.[0-9]+)*")
_SENTENCE = re.compile(r"(?<=[.!?])\s+")
_LEAD = re.compile(r"(?:#+|//+!?|/\*+|\*+/?|;+|--+|%+|<!--|\"{3}|'{3}|REM\b|dnl\b)[ \t]*")


def unmarked(text: str) -> str:
    """The text without comment marks at the ends of its lines."""
    out = []
    for line in text.split("\n"):
        line = line.strip(" \t\r").removesuffix("*/").removesuffix("-->").rstrip()
        mark = _LEAD.match(line)
        out.append(line[mark.end() :] if mark else line)
    return "\n".join(out)


@lru_cache(maxsize=1)
def templates() -> tuple[tuple[str, str], ...]:
    """(identifier, text): the notices, the files of ``templates/``, and the Affero form of the GNU licence, which differs from it in name."""
    folder = resources.files(__package__).joinpath("templates")
    files = {x.name.removesuffix(".txt"): x.read_text(encoding="utf-8") for x in folder.iterdir() if x.name.endswith(".txt")}
    affero = files["GPL-3.0"].replace("GNU GENERAL PUBLIC LICENSE", "GNU AFFERO GENERAL PUBLIC LICENSE").replace("GNU General Public License", "GNU Affero General Public License")
    return (*NOTICES, *sorted((files | {"AGPL-3.0": affero}).items()))


def _terms(text: str) -> Counter:
    return Counter(_WORD.findall(text.lower()))


class Model:
    """TF-IDF vectors of the templates, as a sparse matrix by word."""

    def __init__(self, templates: tuple[tuple[str, str], ...]) -> None:
        counts = [_terms(t) for _, t in templates]
        self.names, n = [x for x, _ in templates], len(templates)
        seen = Counter(w for c in counts for w in c)
        self.idf = {w: math.log((1 + n) / (1 + k)) + 1 for w, k in seen.items()}
        self.unseen = math.log(1 + n) + 1
        self.by_word: dict[str, list[tuple[int, float]]] = {}
        for i, c in enumerate(counts):
            own = {w: (1 + math.log(k)) * self.idf[w] for w, k in c.items()}
            norm = math.sqrt(sum(x * x for x in own.values()))
            for w, x in own.items():
                self.by_word.setdefault(w, []).append((i, x / norm))

    def best(self, text: str) -> tuple[float, str]:
        """(cosine, identifier) of the nearest template; equal ones in order of identifier."""
        dots, norm = [0.0] * len(self.names), 0.0
        for w, k in _terms(text).items():
            x = (1 + math.log(k)) * self.idf.get(w, self.unseen)
            norm += x * x
            for i, y in self.by_word.get(w, ()):
                dots[i] += x * y
        if not norm:
            return 0.0, ""
        top = max(dots)
        return round(top / math.sqrt(norm), 9), min(n for n, d in zip(self.names, dots, strict=True) if d == top)

    def levels(self, text: str) -> list[str]:
        """Finer parts of a text that may be licences: runs of paragraphs, or of a single paragraph the lines, or of a single line the sentences."""
        paragraphs = [x for x in _BLANK.split(text) if x.strip()]
        if len(paragraphs) > 1:
            out: list[list[str]] = []
            for x in paragraphs:
                low = x.lower()
                if any(t in low for t in LEGAL):
                    if out and out[-1]:
                        out[-1].append(x)
                    elif any(t in low for t in TRIGGERS):
                        out.append([x])
                elif out and out[-1]:
                    out.append([])
            runs = [x for x in out if x]
            return ["\n\n".join(x) for x in runs] if runs != [paragraphs] else paragraphs
        lines = [x for x in text.split("\n") if x.strip()]
        if len(lines) > 1:
            return _runs_of(lines) if _runs_of(lines) != ["\n".join(lines)] else lines
        return _SENTENCE.split(text.strip())

    def found(self, text: str) -> list[tuple[float, str, int]]:
        """(cosine, identifier, words) of the licences in a text: the nearest level that is sure, or else the best of this and the finer ones."""
        low = text.lower()
        if not any(t in low for t in TRIGGERS):
            return []
        todo, out = [text], []
        while todo:
            part = todo.pop()
            cosine, name = self.best(part)
            here = [(cosine, name, len(_WORD.findall(part)))] if cosine >= LEAST else []
            if cosine < SURE:
                finer = [x for x in self.levels(part) if any(t in x.lower() for t in TRIGGERS)]
                if finer and finer != [part]:
                    if not here:
                        todo += finer
                        continue
                    below = [y for x in finer for y in self.found(x)]
                    if below and max(y[0] for y in below) > cosine:
                        out += below
                        continue
            out += here
        return out

    def read(self, text: str) -> tuple[list[str], float, int, int]:
        """(identifiers, nearest first, cosine of the first, words of licence text, words) of a whole text."""
        low = text.lower()
        if not any(t in low for t in TRIGGERS):
            return [], 0.0, 0, 0
        found = sorted(self.found(unmarked(text)), key=lambda f: (-f[0], f[1]))
        if not found:
            return [], 0.0, 0, 0
        return list(dict.fromkeys(f[1] for f in found)), found[0][0], sum(f[2] for f in found), len(_WORD.findall(text))


_BLANK = re.compile(r"\n[ \t]*\n")


def _runs_of(lines: list[str]) -> list[str]:
    """Runs of neighbouring lines that have a trigger each."""
    out: list[list[str]] = [[]]
    for x in lines:
        if any(t in x.lower() for t in TRIGGERS):
            out[-1].append(x)
        elif out[-1]:
            out.append([])
    return ["\n".join(x) for x in out if x]


@lru_cache(maxsize=2)
def _model(known: tuple[tuple[str, str], ...]) -> Model:
    return Model(known)


def scan(files: DataFrame, file_id: str = "doc_id", path: str = "path", text: str = "text", known: tuple[tuple[str, str], ...] | None = None) -> DataFrame:
    """(file_id, path, licence, licences, cosine, is_licence_file, effective, inherited_from): one row for each row of ``files``.

    ``licences`` are all found in the text, nearest to its template first, and ``licence`` the first of them, null if
    none reaches the threshold; ``effective`` is that or, failing it, that of the nearest directory above with a licence
    file (of several in one directory the largest cosine, then the smallest identifier, then path), named in
    ``inherited_from``. Null and empty texts have none of their own; without a path nothing is inherited. Whole texts
    are read. Repeated rows give repeated rows, an empty table an empty one; other columns play no part. ``known`` are
    (identifier, text) of the templates, by default ``templates()``.
    """
    known = templates() if known is None else known

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _model(known)
        for b in batches:
            read = [model.read(x or "") for x in b.column(2).to_pylist()]
            mostly = [bool(r[0]) and r[2] >= MOSTLY * r[3] for r in read]
            names = pa.array([r[0] for r in read], pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), names, pa.array(np.array([r[1] for r in read], float)), pa.array(mostly, pa.bool_())], ["file_id", "path", "licences", "cosine", "mostly"])

    rows = files.select(F.col(file_id).cast("long").alias("file_id"), F.col(path).cast("string").alias("path"), F.col(text).cast("string").alias("text"))
    rows = rows.mapInArrow(work, "file_id long, path string, licences array<string>, cosine double, mostly boolean").withColumn("licence", F.get("licences", F.lit(0)))
    rows = rows.withColumn("is_licence_file", F.col("licence").isNotNull() & (F.col("mostly") | F.coalesce(F.col("path").rlike(NAMED), F.lit(False)))).drop("mostly")
    rows = written(rows.withColumn("dir", F.when(F.contains("path", F.lit("/")), F.regexp_replace("path", "/[^/]*$", "")).otherwise(F.when(F.col("path").isNotNull(), F.lit("")))), "licences")
    best = rows.where("is_licence_file and dir is not null").groupBy("dir").agg(F.min(F.struct((-F.col("cosine")).alias("c"), "licence", "path")).alias("best"))
    best = written(best.select(F.col("dir").alias("above"), F.col("best.licence").alias("taken"), F.col("best.path").alias("taken_from")), "directories")
    dirs = rows.where("dir is not null").select("dir").distinct()
    parts = F.split("dir", "/")
    dirs = dirs.withColumn("depth", F.explode(F.sequence(F.lit(0), F.size(parts)))).withColumn("above", F.array_join(F.slice(parts, F.lit(1), F.col("depth")), "/")).distinct()
    nearest = dirs.join(best, "above").groupBy("dir").agg(F.max_by(F.struct("taken", "taken_from"), "depth").alias("t"))
    nearest = written(nearest.select(F.col("dir").alias("_dir"), "t.taken", "t.taken_from"), "nearest")
    out = rows.join(nearest, F.col("dir") == F.col("_dir"), "left")
    return out.select("file_id", "path", "licence", "licences", "cosine", "is_licence_file", F.coalesce("licence", "taken").alias("effective"), F.when(F.col("licence").isNull(), F.col("taken_from")).alias("inherited_from"))
