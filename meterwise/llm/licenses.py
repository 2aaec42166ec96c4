"""Licence scans: TF-IDF cosine of a file's licence lines to templates, and inheritance
from the nearest ancestor directory that has a licence file."""

from __future__ import annotations

import math
import re
from collections import Counter

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from meterwise.llm.arrow import text_slices

# Common notices by SPDX identifier.
TEMPLATES = [
    ("AGPL-3.0", "Licensed under the GNU Affero General Public License, version 3"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("Apache-2.0", "you may not use this file except in compliance with the License"),
    ("BSD-2-Clause", "Licensed under the BSD 2-Clause License"),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License"),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0"),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0"),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0"),
    ("CC0-1.0", "Dedicated to the public domain under CC0 1.0 Universal"),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3"),
    ("ISC", "Licensed under the ISC License"),
    ("LGPL-3.0", "Licensed under the GNU Lesser General Public License, version 3"),
    ("MIT", "Released under the MIT License"),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("Proprietary", "All rights reserved. Unauthorized copying or distribution is prohibited"),
    ("Unlicense", "This is free and unencumbered software released into the public domain"),
]
# A line is compared if it has one of these.
MENTIONS = r"licen[cs]e|copyright|spdx|public domain|permission is hereby|redistribut|all rights reserved"
TERM = r"[a-z0-9]+"
LEAST_COSINE = 0.6
# Names of licence files; a file most of whose words are licence lines is one as well.
LICENSE_FILE = r"(?i)^(licen[cs]e|copying|unlicense)([._-].*)?$"
LEAST_SHARE = 0.5


def terms_of(text: str) -> Counter:
    return Counter(re.findall(TERM, text.lower()))


class TemplateIndex:
    """Sparse vectors of the templates, by term."""

    def __init__(self, templates: list[tuple[str, str]]):
        self.names = [name for name, _ in templates]
        counts = [terms_of(text) for _, text in templates]
        found_in = Counter(t for c in counts for t in c)
        self.unseen = math.log(1 + len(templates)) + 1
        self.idf = {t: math.log((1 + len(templates)) / (1 + n)) + 1 for t, n in found_in.items()}
        self.by_term: dict[str, list[tuple[int, float]]] = {}
        for i, c in enumerate(counts):
            norm = math.sqrt(sum((n * self.idf[t]) ** 2 for t, n in c.items()))
            for t, n in c.items():
                self.by_term.setdefault(t, []).append((i, n * self.idf[t] / norm))

    def best(self, line: str) -> tuple[float, str]:
        """The greatest cosine, to six places, and its template (ties: first name)."""
        weights = {t: n * self.idf.get(t, self.unseen) for t, n in terms_of(line).items()}
        dots: Counter = Counter()
        for t, w in weights.items():
            for i, v in self.by_term.get(t, ()):
                dots[i] += w * v
        norm = math.sqrt(sum(w * w for w in weights.values()))
        scored = [(round(d / norm, 6), self.names[i]) for i, d in dots.items()]
        return min(((s, name) for s, name in scored), key=lambda x: (-x[0], x[1]), default=(0.0, ""))


INDEX = TemplateIndex(TEMPLATES)


@F.arrow_udf(T.StructType().add("license", "string").add("cosine", "double").add("share", "double"))
def own_license(text: pa.Array) -> pa.Array:
    """The licence of each text by its most similar line, null below LEAST_COSINE, and the share
    of its words in such lines."""
    rows: list[tuple] = []
    for part in text_slices(text):
        mentions = pc.match_substring_regex(part, f"(?i){MENTIONS}")
        for hit, value in zip(mentions.to_pylist(), part, strict=True):
            best, words, name = 0.0, 0, None
            if hit:
                whole = value.as_py()
                for line in whole.split("\n"):
                    if not re.search(MENTIONS, line.lower()):
                        continue
                    cosine, license_ = INDEX.best(line)
                    if cosine >= LEAST_COSINE:
                        words += len(re.findall(TERM, line.lower()))
                        if (-cosine, license_) < (-best, name or ""):
                            best, name = cosine, license_
                total = len(re.findall(TERM, whole.lower()))
                rows.append((name, best, words / total if total else 0.0))
            else:
                rows.append((None, 0.0, 0.0))
    columns = list(zip(*rows, strict=True)) or [(), (), ()]
    types = (pa.string(), pa.float64(), pa.float64())
    return pa.StructArray.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["license", "cosine", "share"])


def directory(path: Column) -> Column:
    """The path up to its last slash; empty at the top."""
    return F.when(F.instr(path, "/") > 0, F.regexp_replace(path, r"/[^/]*$", "")).otherwise("")


def ancestors(folder: Column) -> Column:
    """A directory, its parent, and so on to the top."""
    parts = F.split(folder, "/")
    return F.array_union(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/")), F.array(F.lit("")))


def license_labels(files: DataFrame) -> DataFrame:
    """``files`` (``path``, ``text``, and others, which stay) with ``license``, ``cosine``, ``evidence``
    (``header``, ``file``, ``inherited``, ``none``) and ``license_dir``.

    A file's own licence lines decide first. A file without any takes the licence of the
    nearest directory above it that has a licence file; of several, the one of greatest cosine, then of
    first path. Null texts and empty ones have no lines; a null path has no directory
    and inherits nothing. Rows of equal path are files of their own. Columns of these names
    that ``files`` had are replaced. Directories, not files, meet their ancestors, so a
    directory of many files costs one row.
    """
    columns = [c for c in files.columns if c not in ("license", "cosine", "evidence", "license_dir")]
    judged = files.select(*columns, own_license("text").alias("_own")).withColumn("_dir", directory(F.col("path")))
    by_name = F.regexp_replace("path", r"^.*/", "").rlike(LICENSE_FILE)
    is_file = F.col("_own.license").isNotNull() & (by_name | (F.col("_own.share") >= LEAST_SHARE))
    slim = files.select("path", own_license("text").alias("_own")).withColumn("_dir", directory(F.col("path"))).where(is_file & F.col("path").isNotNull())
    licensed = slim.groupBy(F.col("_dir").alias("license_dir")).agg(
        F.min_by(F.col("_own.license"), F.struct(-F.col("_own.cosine"), F.col("path"), F.col("_own.license"))).alias("_inherited")
    )
    folders = files.select(directory(F.col("path")).alias("_dir")).where("_dir is not null").distinct()
    above = folders.select("_dir", F.explode(ancestors(F.col("_dir"))).alias("license_dir")).join(licensed, "license_dir")
    nearest = above.groupBy("_dir").agg(F.max_by(F.struct("license_dir", "_inherited"), F.length("license_dir")).alias("_near"))
    labelled = judged.join(nearest, "_dir", "left").withColumn("_is_file", is_file)
    own = F.col("_own.license")
    evidence = F.when(own.isNotNull(), F.when(F.col("_is_file"), "file").otherwise("header")).when(F.col("_near").isNotNull(), "inherited").otherwise("none")
    return labelled.select(
        *columns,
        F.coalesce(own, "_near._inherited").alias("license"),
        F.col("_own.cosine").alias("cosine"),
        evidence.alias("evidence"),
        F.when(own.isNull(), F.col("_near.license_dir")).alias("license_dir"),
    )
