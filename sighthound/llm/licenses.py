"""License scans by conditional compression."""

from __future__ import annotations

import re
from bisect import bisect_right
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import documents, make_room, schema_of, small_batches

#: Public wordings of license notices; numbers of clauses, which differ, are left out.
BSD = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
    "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
    "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
)
BSD_THIRD = "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
#: ``BSD`` is the opening that two and three clauses share, where the clauses themselves don't follow.
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0'),
    ("BSD", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("BSD-2-Clause", BSD),
    ("BSD-3-Clause", f"{BSD} {BSD_THIRD}"),
    ("BSD-3-Clause", BSD_THIRD),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("MIT", "Released under the MIT License."),
    ("MIT", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction'),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
)
CUE = re.compile(r"licen[cs]e|copyright|redistribut|permission|public[\W_]+domain|creative[\W_]+commons|spdx", re.I)
WORD = re.compile(r"[^\W\d_]+|\d+(?:\.\d+)*")
#: Share of wording that may be missing or added.
MISSING, EXTRA = 0.1, 0.25


class Scanner:
    def __init__(self, templates=TEMPLATES):
        import zstandard as z

        sizes = [len(WORD.findall(wording)) for _, wording in templates]
        #: Words taken before and behind a cue, on whatever line: the longest template and what may be added to it.
        self.around = max(n + int(EXTRA * n) for n in sizes)
        if not all(CUE.search(wording) for _, wording in templates):
            raise ValueError("a template without a cue could not be found")
        options = {"write_content_size": False, "write_checksum": False, "write_dict_id": False}
        self.plain = z.ZstdCompressor(level=19, **options)
        self.templates = []
        for name, wording in templates:
            words = WORD.findall(wording.lower())
            known = z.ZstdCompressionDict(" ".join(words).encode(), dict_type=z.DICT_TYPE_RAWCONTENT)
            self.templates.append((name, words, z.ZstdCompressor(level=19, dict_data=known, **options)))

    def blocks(self, text: str):
        """Candidates: ``around`` words before and behind each cue, across line breaks, overlapping ranges as one; lists of (begin, end, word)."""
        cues = [m.start() for m in CUE.finditer(text)]
        if not cues:
            return
        words = [(m.start(), m.end(), m[0].lower()) for m in WORD.finditer(text)]
        ends = [w[1] for w in words]
        begin = end = 0
        for cue in cues:
            at = bisect_right(ends, cue)
            if at - self.around > end:
                if end:
                    yield words[begin:end]
                begin = at - self.around
            end = min(at + self.around + 1, len(words))
        yield words[begin:end]

    def fits(self, wording: list[str], words: list[str]):
        """All places of ``words`` where a wording stands, within the shares that may be missing or added: (first, end, missing, extra).

        From each word that may be the first, the least edits to each end: words of the wording left out (never a
        number, so versions are all there) or words put in.
        """
        m, miss, more = len(wording), int(MISSING * len(wording)), int(EXTRA * len(wording))
        known, firsts = set(wording), set(wording[: miss + 1])
        far = m + more + 1
        for at in [i for i, w in enumerate(words) if w in firsts]:
            window = words[at : at + m + more]
            if len(known.difference(window)) > miss:
                continue
            width = len(window)
            row = list(range(width + 1))
            for i, w in enumerate(wording, 1):
                new = [far] * (width + 1)
                skip = not w[0].isdigit()
                if skip and i <= miss:
                    new[0] = i
                for j in range(max(1, i - miss), min(width, i + more) + 1):
                    least = new[j - 1] + 1
                    if skip and row[j] + 1 < least:
                        least = row[j] + 1
                    if w == window[j - 1] and row[j - 1] < least:
                        least = row[j - 1]
                    new[j] = least
                row = new
            for size, edits in enumerate(row):
                missing, extra = (m - size + edits) // 2, (size - m + edits) // 2
                if size and missing <= miss and extra <= more:
                    yield at, at + size, missing, extra

    def match(self, block: list[tuple[int, int, str]]) -> list[tuple]:
        """The confirmed notices of a block: (license, begin, end, reduction, words missing, words added).

        Of places that overlap the one counts that has the most words of its template less those missing or added, so that a
        notice goes before the part of it that another one shares; then the one with fewer missing or added, then the
        template under which the block shrinks more, then the first.
        """
        words = [w for _, _, w in block]
        content = " ".join(words).encode()
        plain = len(self.plain.compress(content))
        ranked = sorted(((1 - len(c.compress(content)) / plain, i) for i, (_, _, c) in enumerate(self.templates)), key=lambda x: (-x[0], x[1]))
        places = []
        for rank, (gain, i) in enumerate(ranked):  # all: a near miss may shrink a block more than the notice that it holds
            name, wording, _ = self.templates[i]
            places += [(2 * missing + extra - len(wording), missing + extra, rank, at, end, name, gain, missing, extra) for at, end, missing, extra in self.fits(wording, words)]
        found, taken = [], bytearray(len(words))
        for _, _, _, at, end, name, gain, missing, extra in sorted(places):
            if not any(taken[at:end]):
                taken[at:end] = b"\1" * (end - at)
                found.append((name, block[at][0], block[end - 1][1], gain, missing, extra))
        return found

    def scan(self, text: str) -> tuple[int, list[tuple]]:
        """Number of candidate blocks and confirmed notices of a text."""
        seen, found = 0, []
        for block in self.blocks(text):
            seen += 1
            found += self.match(block)
        return seen, sorted(found, key=lambda x: x[1:])


@lru_cache(1)
def scanner() -> Scanner:
    return Scanner()


NOTICE = "struct<license:string,begin:bigint,end:bigint,reduction:double,missing:bigint,extra:bigint>"


def scan_licenses(docs: DataFrame, text: str = "text") -> DataFrame:
    """Append ``license_blocks`` (candidates) and ``notices`` (confirmed, with code point offsets). Null and empty texts have none.

    Texts and lines of any length are read whole. Columns of the input with the names of the results get ``input_`` before
    theirs. Rows keep to themselves, so repeated rows get equal results; an empty table gives no rows. See ``Scanner.match``
    for ties between templates.
    """
    docs, names = make_room(docs, ("license_blocks", "notices"))
    text = names[text]
    fields = [("license", pa.string()), ("begin", pa.int64()), ("end", pa.int64()), ("reduction", pa.float64()), ("missing", pa.int64()), ("extra", pa.int64())]

    def run(batches):
        scan = scanner().scan
        for batch in batches:
            done = [scan(x or "") for x in batch[text].to_pylist()]
            notices = pa.array([[dict(zip([f[0] for f in fields], n, strict=True)) for n in d[1]] for d in done], pa.list_(pa.struct(fields)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([d[0] for d in done], pa.int64()), notices], [*batch.schema.names, "license_blocks", "notices"])

    small_batches(docs.sparkSession)
    return docs.mapInArrow(run, schema_of(docs, f"license_blocks bigint, notices array<{NOTICE}>"))


def op8_license_scan(spark, sf_dir: str) -> DataFrame:
    """License notices of every document."""
    df = scan_licenses(documents(spark, sf_dir).select("doc_id", "text"))
    return df.select("doc_id", "license_blocks", F.size("notices").cast("long").alias("n_notices"), F.array_join(F.array_sort(F.array_distinct("notices.license")), ",").alias("licenses"), F.to_json("notices").alias("notices"))
