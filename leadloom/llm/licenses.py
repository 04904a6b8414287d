"""License scans by conditional compression.

A template of m fixed words may differ from a text in DIFFERENCES of them: k words that are missing, added or changed (a `*` stands for up to
FREE_WORDS free words, or none). Cut into k + 1 pieces, one of them must stand in the text word for word, wherever in a line or sentence that
is; pieces are looked up by their longest word. Around each piece that stands there the rest of the template is laid against the words before and
behind, for the fewest differences; what it covers is a candidate block for that template.

Each block is compressed alone and with the templates that it is a candidate for as raw zstandard dictionaries, and they are ranked by how much of
the block's size they save. Of blocks that overlap the one that compression ranks first counts (most bytes saved, then the fewest differences, then the
first by name), unless one without a difference overlaps it and explains as many words (fixed words less differences): that is the wording itself, and
counts in its stead. The differences in wording are reported.

Null and empty texts have no licenses; each mention is a row of its own, so repeated lines and documents are repeated rows. A text of any
length is read whole; of its words a worker holds twelve bytes each. Other columns are ignored. An empty table gives an empty result.
"""

import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leadloom.llm.common import slices

#: The wording of public license notices.
TEMPLATES = {
    "All rights reserved": "All rights reserved.",
    "Apache-2.0 (notice)": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0 (header)": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.',
    "BSD-2-Clause (conditions)": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "CC-BY-4.0 (notice)": "Licensed under CC BY 4.0.",
    "CC-BY-NC-4.0 (notice)": "Licensed under CC BY-NC 4.0.",
    "CC-BY-SA-4.0 (notice)": "Licensed under CC BY-SA 4.0.",
    "CC0-1.0 (notice)": "This work has been marked as dedicated to the public domain.",
    "GPL-2.0 (notice)": "This work is licensed under the GNU General Public License, version 2.",
    "GPL-3.0 (notice)": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0 (header)": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "ISC (grant)": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "MIT (notice)": "Released under the MIT License.",
    "MIT (grant)": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:',
    "MPL-2.0 (header)": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "Rights reserved": "Copyright * All rights reserved.",
}

CUE = r"(?i)licen[sc]e|copyright|redistribut|permission|public domain|rights reserved"
DIFFERENCES, LEVEL, FREE_WORDS = 0.12, 3, 8

WORD = re.compile(r"[^\W_]+(?:[.\-'][^\W_]+)*|\*")
MATCHES = "doc_id long, line long, start long, end long, license string, reduction double, template_words long, n_differences long, differences array<string>, exact boolean"


def words(text: str) -> list[tuple[str, int, int]]:
    """Lower-case words with their places."""
    return [(m[0].lower(), m.start(), m.end()) for m in WORD.finditer(text)]


def pieces_of(wanted: list[str], n: int) -> list[tuple[int, list[str]]]:
    """At least n pieces of a template without its free words, as long as can be, and where they start."""
    runs: list[tuple[int, list[str]]] = [(0, [])]
    for at, word in enumerate(wanted):
        if word == "*":
            runs.append((at + 1, []))
        else:
            runs[-1][1].append(word)
    size = max(len(run) for _, run in runs)
    while size > 1 and sum(len(run) // size for _, run in runs) < n:
        size -= 1
    cut = [(start, run, len(run) // size) for start, run in runs if run]
    # a run's last piece takes what is left over
    return [(start + k * size, run[k * size :] if k == pieces - 1 else run[k * size : (k + 1) * size]) for start, run, pieces in cut for k in range(pieces)]


def extended(wanted: list[int], have: list[int], most: int) -> tuple[int, int] | None:
    """The fewest differences, up to most, between wanted and a beginning of have, and how long that is, the shortest; FREE stands for free words."""
    if wanted == have[: len(wanted)]:
        return 0, len(wanted)
    n = len(have) + 1
    row = list(range(n))
    for word in wanted:
        if word == FREE:
            row = [min(row[max(0, j - FREE_WORDS) : j + 1]) for j in range(n)]
            continue
        new = [row[0] + 1]
        for j in range(1, n):
            new.append(min(row[j] + 1, new[j - 1] + 1, row[j - 1] + (have[j - 1] != word)))
        row = new
        if min(row) > most:
            return None
    best = min(row)
    return (best, row.index(best)) if best <= most else None


def differences_of(wanted: list[str], have: list[str]) -> list[str]:
    """The differences of a way with fewest from wanted to all of have, neighbouring ones together."""
    rows: list[list[tuple[int, str, int]]] = [[(j, "add", 1) if j else (0, "", 0) for j in range(len(have) + 1)]]
    for word in wanted:
        above, new = rows[-1], []
        for j in range(len(have) + 1):
            if word == "*":
                cost, step = min((above[j - d][0], d) for d in range(min(j, FREE_WORDS) + 1))
                new.append((cost, "free", step))
                continue
            ways = [(above[j][0] + 1, "lack", 0)]
            if j:
                same = have[j - 1] == word
                ways += [(above[j - 1][0] + (not same), "keep" if same else "swap", 1), (new[j - 1][0] + 1, "add", 1)]
            new.append(min(ways, key=lambda w: (w[0], ("keep", "swap", "lack", "add").index(w[1]))))
        rows.append(new)
    i, j, out, minus, plus = len(wanted), len(have), [], [], []

    def close() -> None:
        if minus or plus:
            out.append(f"-{' '.join(reversed(minus))} +{' '.join(reversed(plus))}")
            minus.clear()
            plus.clear()

    while i or j:
        _, how, step = rows[i][j]
        if how in ("keep", "free"):
            close()
        if how in ("swap", "lack"):
            minus.append(wanted[i - 1])
        if how in ("swap", "add"):
            plus.append(have[j - 1])
        i, j = i - (how != "add"), j - step
    close()
    return out[::-1]


def regions(ranked: list[tuple]) -> Iterator[list[tuple]]:
    """Candidates (saved size below 0, differences, share, name, start, end, template's words) in stretches that no candidate links."""
    region, last = [], 0
    for mention in sorted(ranked, key=lambda x: x[4:6]):
        if region and mention[4] >= last:
            yield region
            region = []
        last = max(last, mention[5]) if region else mention[5]
        region.append(mention)
    if region:
        yield region


def chosen(region: list[tuple]) -> list[tuple]:
    """Candidates that count, which do not overlap: in the order of compression, each unless an exact one that it overlaps explains as many words."""
    explained = lambda x: sum(w != "*" for w in x[6]) - x[1]
    overlaps = lambda x, y: x[4] < y[5] and y[4] < x[5]
    left, kept = sorted(region, key=lambda x: x[:6]), []
    while left:
        best = left[0]
        # more words each time, or the same without a difference, so this ends
        while better := [x for x in left if not x[1] and overlaps(x, best) and (explained(x), -x[1]) > (explained(best), -best[1])]:
            best = max(better, key=explained)
        kept.append(best)
        left = [x for x in left if not overlaps(x, best)]
    return kept


#: Ids of words that no template has, and of free ones.
OTHER, FREE = -1, -2


class Scanner:
    """Templates with their words and compressors, and where their pieces' longest words lead."""

    def __init__(self, templates: dict[str, str]):
        self.templates = [(name, [w for w, _, _ in words(t)], zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(t.lower().encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT))) for name, t in sorted(templates.items())]
        self.alone = zstandard.ZstdCompressor(level=LEVEL)
        self.known = {w: i for i, w in enumerate(sorted({w for _, wanted, _ in self.templates for w in wanted if w != "*"}))}
        self.wanted = [[self.known.get(w, FREE) for w in wanted] for _, wanted, _ in self.templates]
        self.most = [int(DIFFERENCES * sum(w != "*" for w in wanted)) for _, wanted, _ in self.templates]
        self.pieces: dict[int, list[tuple[int, int, int, bytes]]] = {}
        for number, (_, wanted, _) in enumerate(self.templates):
            for start, piece in pieces_of(wanted, self.most[number] + 1):
                word = max(piece, key=len)
                self.pieces.setdefault(self.known[word], []).append((number, start, piece.index(word), np.array([self.known[w] for w in piece], np.int32).tobytes()))
        self.leads = np.zeros(len(self.known) + 1, bool)
        self.leads[list(self.pieces)] = True
        self.words = [w for w, i in self.known.items() if i in self.pieces]

    def possible(self, text: str) -> bool:
        """Whether a text holds the longest word of some piece; without one it has no mention."""
        low = text.lower()
        return any(word in low for word in self.words)

    def tokens(self, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids, starts and ends of a text's words."""
        ids, starts, ends = array("i"), array("i"), array("i")
        for m in WORD.finditer(text):
            ids.append(self.known.get(m[0].lower(), OTHER))
            starts.append(m.start())
            ends.append(m.end())
        return tuple(np.frombuffer(x, np.int32) if len(x) else np.zeros(0, np.int32) for x in (ids, starts, ends))

    def candidates(self, ids: np.ndarray) -> list[tuple[int, int, int, int]]:
        """(template, start, end, differences) for each block around a piece that a template explains."""
        found, last = [], {}
        for at in np.flatnonzero(self.leads[ids]).tolist():
            for number, start, shift, piece in self.pieces[int(ids[at])]:
                here, size = at - shift, len(piece) // 4
                if here < 0 or ids[here : here + size].tobytes() != piece or here < last.get(number, 0):
                    continue
                wanted, most = self.wanted[number], self.most[number]
                slack = most + FREE_WORDS * wanted.count(FREE)
                rest, head = wanted[start + size :], wanted[:start][::-1]
                behind = extended(rest, ids[here + size : here + size + len(rest) + slack].tolist(), most)
                before = behind and extended(head, ids[max(0, here - len(head) - slack) : here][::-1].tolist(), most - behind[0])
                if before:
                    end = here + size + behind[1]
                    found.append((number, here - before[1], end, before[0] + behind[0]))
                    last[number] = end
        return found

    def scan(self, text: str) -> list[dict]:
        """Mentions in a text, in order. They do not overlap."""
        ids, starts, ends = self.tokens(text)
        ranked, sizes, blocks = [], {}, {}
        for number, start, end, n in self.candidates(ids):
            name, wanted, compressor = self.templates[number]
            if (start, end) not in blocks:
                blocks[start, end] = [text[starts[i] : ends[i]].lower() for i in range(start, end)]
                sizes[start, end] = len(self.alone.compress(" ".join(blocks[start, end]).encode("utf-8", "surrogatepass")))
            size = len(compressor.compress(" ".join(blocks[start, end]).encode("utf-8", "surrogatepass")))
            ranked.append((size - sizes[start, end], n, size / sizes[start, end], name, start, end, wanted))
        kept = [mention for region in regions(ranked) for mention in chosen(region)]
        found, number, counted = [], 0, 0
        for _, n, share, name, start, end, wanted in sorted(kept, key=lambda x: x[4]):
            cue = re.compile(CUE).search(text, starts[start], ends[end - 1])
            place = cue.start() if cue else int(starts[start])
            number, counted = number + text.count("\n", counted, place), place
            differences = differences_of(wanted, blocks[start, end]) if n else []
            found.append({"line": number, "start": int(starts[start]), "end": int(ends[end - 1]), "license": name, "reduction": 1 - share, "template_words": len(wanted), "n_differences": len(differences), "differences": differences, "exact": not n})
        return found


def license_mentions(docs: DataFrame, templates: dict[str, str] = TEMPLATES) -> DataFrame:
    """A row for each license mention in docs (doc_id, text): where, which, how much it compresses, and its differences in wording."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(templates)
        for batch in batches:
            for piece in slices(iter([batch]), "text"):
                rows = [{"doc_id": d, **m} for d, t in zip(piece.column("doc_id").to_pylist(), piece.column("text").to_pylist()) if scanner.possible(t) for m in scanner.scan(t)]
                yield pa.RecordBatch.from_pylist(rows, schema)

    schema = pa.schema([("doc_id", pa.int64()), ("line", pa.int64()), ("start", pa.int64()), ("end", pa.int64()), ("license", pa.string()), ("reduction", pa.float64()), ("template_words", pa.int64()), ("n_differences", pa.int64()), ("differences", pa.list_(pa.string())), ("exact", pa.bool_())])
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").filter("text is not null").mapInArrow(scan, MATCHES)


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every license mention in documents."""
    found = license_mentions(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return found.select("doc_id", "line", "start", "end", "license", F.round("reduction", 6).alias("reduction"), "n_differences", F.array_join("differences", "; ").alias("differences"), "exact")
