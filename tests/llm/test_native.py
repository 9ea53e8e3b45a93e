"""The operators made of column expressions, against SQL and plain Python."""

import hashlib
import random
import re

import pytest
from conftest import SMALL, same_rows
from pyspark.sql import functions as F

from larkspur.llm import decontaminate, fingerprint, licenses, line_dedup, pii, queries

from .odd import TEXTS, count, jaccard, no_documents, odd_documents, shingles_of, small, texts, words_of


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_same_as_sql(spark, duck, name):
    same_rows(queries.queries()[name](spark, SMALL), duck.sql(queries.oracle_sql()[name]))


# lines


def deduped_by_brute_force(rows, least):
    """(text, n_lines, n_boilerplate, n_removed, whole_copy) of each (text, source)."""
    at: dict[str, set] = {}
    for t, source in rows:
        for line in (t or "").split("\n"):
            at.setdefault(line, set()).update([source] if source is not None else [])
    bad = {line for line, on in at.items() if len(on) >= least and line.strip()}
    chars = lambda t, some: sum(len(line) for line in set((t or "").split("\n")) if line.strip() and some(line))
    heavy = [i for i, (t, _) in enumerate(rows) if chars(t, lambda line: line in bad) > 0.5 * chars(t, lambda line: True)]
    same = lambda a, b: a == b or (shingles_of(a) and shingles_of(b) and jaccard(shingles_of(a), shingles_of(b)) >= 0.8)
    copies = {i for i in heavy if any(j != i and same(rows[i][0], rows[j][0]) for j in heavy)}
    out = []
    for i, (t, _) in enumerate(rows):
        lines = (t or "").split("\n")
        rest = [x for x in lines if x not in bad]
        n = len(lines) - len(rest)
        out.append((t, len(lines), n, 0, True) if i in copies else (t if n == 0 else "\n".join(rest), len(lines), n, n, False))
    return out


def as_deduped(r):
    return r.text, r.n_lines, r.n_boilerplate, r.n_removed, r.whole_copy


def test_boilerplate_like_brute_force(spark):
    rnd = random.Random(1)
    lines = [f"line {i}" for i in range(12)]
    values = ["\n".join(rnd.choice([*lines, "own text %d of this document only" % n, " "]) for _ in range(rnd.randint(1, 9))) for n in range(120)]
    sources = [f"s{rnd.randint(0, 11)}" for _ in values]
    for least in (3, 9, 12):
        want = deduped_by_brute_force(list(zip(values, sources, strict=True)), least)
        got = {r.doc_id: as_deduped(r) for r in line_dedup.dedup_lines(texts(spark, values, sources), min_sites=least).collect()}
        assert [got[i] for i in range(len(values))] == want
        assert least == 12 or any(w[4] for w in want) and any(w[0] == "" for w in want)


def test_copies_are_proven(spark, monkeypatch):
    monkeypatch.setattr(line_dedup, "MAX_BROADCAST_LINES", 5)
    rnd = random.Random(2)
    word = lambda: f"w{rnd.randint(0, 5000)}"
    values = []
    for _ in range(8):
        base = [[word() for _ in range(12)] for _ in range(10)]
        for _ in range(12):
            own = [list(line) for line in base]
            own[rnd.randint(0, 9)][rnd.randint(0, 11)] = word()
            values.append("\n".join(map(" ".join, own)))
    footer = " ".join(word() for _ in range(12))
    values += [f"{footer}\n{word()} {word()}" for _ in range(12)]
    sources = [f"s{i % 12}" for i in range(len(values))]
    want = deduped_by_brute_force(list(zip(values, sources, strict=True)), 8)
    got = {r.doc_id: as_deduped(r) for r in line_dedup.dedup_lines(texts(spark, values, sources)).collect()}
    assert [got[i] for i in range(len(values))] == want
    assert sum(w[4] for w in want) > 80 and not any(w[4] for w in want[-12:]) and all(w[3] == 1 for w in want[-12:])


def test_no_copy_is_lost_in_a_crowd(spark):
    """2,000 texts that resemble each other by 0.6 and hold pairs at 0.8 to 0.9, and a group whose members resemble its middle only."""
    rnd = random.Random(3)
    word = lambda: f"w{rnd.randint(0, 10**9)}"
    common, values = [word() for _ in range(154)], []
    for _ in range(800):
        values.append(" ".join(common + [word() for _ in range(50)]))
    for i in range(600):
        own, n = [word() for _ in range(50)], 22 + i % 27
        values += [" ".join(common + own), " ".join(common + own[:n] + [word() for _ in range(50 - n)])]
    middle = [word() for _ in range(300)]
    for i in range(60):
        values.append(" ".join(middle[:i] + [word()] + middle[i + 1 : 150 + i] + [word() for _ in range(3)] + middle[153 + i :]))
    sets = [shingles_of(v) for v in values]
    seen = {}
    for i, s in enumerate(sets):
        for x in s:
            seen.setdefault(x, []).append(i)
    near = set()
    for i, s in enumerate(sets):
        others = {j for x in s if len(seen[x]) < 500 for j in seen[x] if j != i}
        if any(jaccard(s, sets[j]) >= 0.8 for j in others):
            near.add(i)
    assert 0.55 < jaccard(sets[0], sets[1]) < 0.62 and 600 < len(near) < 1260
    docs = texts(spark, values)
    keys = docs.select("doc_id", F.xxhash64("text").alias("text_key"), F.lit(1).cast("long").alias("times"))
    found = {r.text_key for r in line_dedup.copies(docs, keys).collect()}
    assert {r.doc_id for r in keys.collect() if r.text_key in found} == near


def test_a_crowd_with_a_common_line_makes_no_pairs(spark):
    """Texts that share twelve of fifteen shingles are of similarity 0.67; one of them has a copy of similarity 0.88."""
    rows = [(i, [*range(12), *(1000 + 10 * i + k for k in range(3))]) for i in range(300)] + [(1000, [*range(11), 1000, 1001, 1002, 9999])]
    each = spark.createDataFrame(rows, "text_key long, shingles array<long>")
    pairs = line_dedup._prefix_pairs(each.select("text_key"), each, line_dedup.NEAR)
    assert pairs.count() < 1000
    assert {r.text_key for r in line_dedup._alike(pairs, each, line_dedup.NEAR).collect()} == {0, 1000}


def test_line_dedup_odd(spark):
    docs = odd_documents(spark)
    for least in (1, 2):
        got = line_dedup.dedup_lines(docs, min_sites=least)
        assert count(got) == len(TEXTS) and {"word", "key", "k1", "n_lines", "text_key"} <= set(got.columns)
        want = deduped_by_brute_force([(r.text, r.source) for r in docs.collect()], least)
        assert sorted(map(str, map(as_deduped, got.collect()))) == sorted(map(str, want))
    assert count(line_dedup.dedup_lines(no_documents(spark))) == 0


# personal data

BASE = {
    "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
    "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(p) <= 255 for p in m.split("."))),
    "card": (r"[0-9]([\x20-]?[0-9])+", lambda m: 14 <= len(re.sub(r"\D", "", m)) <= 19 and luhn(re.sub(r"\D", "", m))),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 10 <= len(re.sub(r"\D", "", m)) <= 15),
}


def luhn(digits):
    return sum(sum(divmod(int(d) * (1 + i % 2), 10)) for i, d in enumerate(reversed(digits))) % 10 == 0


def base_spans(text):
    return sorted((m.start(), rank, kind, m.end()) for rank, (kind, (pattern, valid)) in enumerate(BASE.items()) for m in re.finditer(pattern, text) if valid(m.group()))


def test_pii_like_brute_force(spark):
    rnd = random.Random(2)
    parts = ["a@b.c", "_x@d.e", "1.2.3.4", ".5.6", "999.1.1.1", "0255.01.2.3", "+1 (202) 555-0101", "+44", "4111 1111 1111 1111", "4111-1111-1111-1112", "é", "😀", " ", "\n", "-", "@", "+", "7", "x", ".", "DE89370400440532013000", " ssn 123-45-6789 "]
    values = ["", *("".join(rnd.choice(parts) for _ in range(rnd.randint(0, 14))) for _ in range(400)), "a@b.cc " * 1500 + "x"]
    got = {r.doc_id: r for r in pii.digest(pii.find_pii(texts(spark, values))).collect()}
    for i, t in enumerate(values):
        spans = base_spans(t)
        digest = hashlib.sha256(",".join(f"{k}:{a}:{e}" for a, _, k, e in spans).encode()).hexdigest()
        assert got[i].base_sha256 == digest, t
        assert [got[i][f"n_{k}"] for k in BASE] == [sum(s[2] == k for s in spans) for k in BASE]


def test_pii_scores(spark):
    values = ["call me at +1 (202) 555-0101", "+1 (202) 555-0101", "iban DE89 3704 0044 0532 0130 00", "DE88 3704 0044 0532 0130 00", "ssn 123-45-6789", "code 123-45-6789"]
    got = {r.doc_id: r.spans for r in pii.find_pii(texts(spark, values)).collect()}
    assert [[(s.kind, s.score) for s in got[i]] for i in range(6)] == [[("phone", 0.8)], [("phone", 0.6)], [("iban", 0.9)], [], [("ssn", 0.6)], []]
    assert got[2][0].text == "DE89 3704 0044 0532 0130 00"


def test_ibans_before_other_words(spark):
    ibans = ["DE89 3704 0044 0532 0130 00", "GB82 WEST 1234 5698 7654 32", "NO93 8601 1117 947", "FR1420041010050500013M02606"]
    values = [f"IBAN: {iban} {after}" for iban in ibans for after in ("BIC COBADEFFXXX", "2024", "B", "")]
    got = {r.doc_id: [s.text for s in r.spans if s.kind == "iban"] for r in pii.find_pii(texts(spark, values)).collect()}
    assert [got[i] for i in range(len(values))] == [[iban] for iban in ibans for _ in range(4)]


def test_base_kinds_like_sql(spark, duck):
    names = ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256"]
    same_rows(pii.digest(pii.find_pii(small(spark))).select(*names), duck.sql(pii.BASE_SQL))


def test_pii_takes_long_runs(spark):
    import time

    began = time.time()
    runs = ["a. " + "1" * 1_000_000, "1." * 300_000, "1 " * 300_000, "+" * 500_000, "+1" * 300_000, "A" * 1_000_000, "DE89" * 200_000, "1-" * 300_000, "a@" * 300_000]
    assert {r.n_ip for r in pii.digest(pii.find_pii(texts(spark, runs))).filter("doc_id <> 1").collect()} == {0}
    assert time.time() - began < 60
    tricky = ["1.2.3.4.5.6.7.8", "999.1.2.3.4", "01.2.3.4 5.6.7.8.9", "1..2.3.4.5", "x1.2.3.4x"]
    for r, t in zip(pii.digest(pii.find_pii(texts(spark, tricky))).orderBy("doc_id").collect(), tricky, strict=True):
        assert r.base_sha256 == hashlib.sha256(",".join(f"{k}:{a}:{z}" for a, _, k, z in base_spans(t)).encode()).hexdigest(), t


def test_pii_odd(spark):
    evil = texts(spark, ["x@" + "a." * 40_000 + "b", "z" * 60_000 + "@", "+1" + "(" * 60_000, "1 " * 40_000, None])
    assert [r.n_email for r in pii.digest(pii.find_pii(evil)).orderBy("doc_id").collect()] == [1, 0, 0, 0, 0]
    assert count(pii.digest(pii.find_pii(odd_documents(spark)))) == len(TEXTS)
    assert count(pii.digest(pii.find_pii(no_documents(spark)))) == 0


# licenses


def found(spark, values):
    return [(r.licenses, r.category) for r in licenses.digest(licenses.scan_licenses(texts(spark, values))).orderBy("doc_id").collect()]


def test_licenses(spark):
    want = {
        "Released under the MIT License.": ("MIT", "permissive"), "This library is licensed under the MIT license.": ("MIT", "permissive"), "Licensed under the MIT License (see LICENSE).": ("MIT", "permissive"), "Mitigating license plates.": ("", "none"),
        "Licensed under the Apache License, Version 2.0. All rights reserved.": ("Apache-2.0", "permissive"), "All Rights Reserved": ("Proprietary", "restricted"), None: ("", "none"), "": ("", "none"),
        "Licensed under CC BY-NC 4.0.\nThis work is licensed under the GNU General Public License, version 3.": ("CC-BY-NC-4.0,GPL-3.0", "restricted"), "It comes under the terms of nobody.": ("", "none"), "Distributed under the terms of the GPLv2.": ("GPL-2.0", "copyleft"),
        "available under a Creative Commons Attribution-ShareAlike 4.0 International License": ("CC-BY-SA-4.0", "copyleft"), "# License: distributed under the Boost Software License, Version 1.0.": ("BSL-1.0", "permissive"), "Published under the GNU Lesser General Public License v2.1": ("LGPL-2.1", "copyleft"),
        "/* SPDX-License-Identifier: LGPL-2.1-or-later */": ("LGPL-2.1", "copyleft"), "-- SPDX-License-Identifier: BSD-3-Clause": ("BSD-3-Clause", "permissive"), "SPDX-License-Identifier: EPL-2.0": ("EPL-2.0", "copyleft"),
        "Unauthorized copying of this file, via any medium is strictly prohibited.": ("Proprietary", "restricted"),
    }
    assert dict(zip(want, found(spark, list(want)), strict=True)) == want


def test_the_catalogue():
    known = licenses.SENTENCES
    assert len(known) > 300 and len({name for name, _, _ in licenses.RULES}) > 40
    assert all(re.search(licenses.ANCHORS, s) for s in known) and all(re.fullmatch("[a-z0-9]+( [a-z0-9]+)*", s) for s in known)
    assert {i for _, _, ids in licenses.RULES for i in ids} <= set(known.values())
    assert all(re.search(licenses.PATTERN, f" {s} ")[0] == s for s in known)


#: Texts of licenses as systems and packages carry them, where they lie; they aren't part of this repository.
REAL = {
    "Apache-2.0": "Apache-2.0", "Artistic": "Artistic-1.0", "BSD": "BSD-3-Clause", "CC0-1.0": "CC0-1.0", "GFDL-1.2": "GFDL-1.2", "GFDL-1.3": "GFDL-1.3", "GPL-1": "GPL-1.0", "GPL-2": "GPL-2.0", "GPL-3": "GPL-3.0", "LGPL-2": "LGPL-2.0", "LGPL-2.1": "LGPL-2.1", "LGPL-3": "LGPL-3.0", "MPL-1.1": "MPL-1.1", "MPL-2.0": "MPL-2.0",
}
PACKAGES = {"urllib3": "MIT", "idna": "BSD-3-Clause", "requests": "Apache-2.0", "pluggy": "MIT", "psutil": "BSD-3-Clause", "pygments": "BSD-2-Clause", "hypothesis": "MPL-2.0", "sortedcontainers": "Apache-2.0", "numpy": "BSD-3-Clause", "xxhash": "BSD-2-Clause", "pytz": "MIT", "zstandard": "BSD-3-Clause", "tiktoken": "MIT", "pydantic_core": "MIT", "charset_normalizer": "MIT", "pyyaml": "MIT", "pip": "MIT"}


def test_licenses_of_files(spark):
    import sysconfig
    from pathlib import Path

    files = {p: want for name, want in REAL.items() if (p := Path("/usr/share/common-licenses") / name).exists()}
    site = Path(sysconfig.get_paths()["purelib"])
    files |= {p: want for name, want in PACKAGES.items() for p in sorted(site.glob(f"{name}-*.dist-info/**/LICENSE*"))[:1]}
    if not files:
        pytest.skip("no license texts here")
    got = found(spark, [p.read_text(errors="replace") for p in files])
    assert {str(p): names for p, (names, _), want in zip(files, got, files.values(), strict=True) if want not in names.split(",")} == {}


def test_licenses_like_sql(spark, duck):
    """Whole texts, wrapped, in comments and out of order, in both engines."""
    import duckdb

    wrap = lambda t, mark: "\n".join(f"{mark}{line}" for line in t.split("\n"))
    values = [wrap(t, mark) for t in (MIT, BSD, GPL, APACHE, MPL) for mark in ("", "// ", " * ", "dnl ", "\r")] + [BSD + MIT, MIT[200:], "licensed under the MIT license " * 3, "All rights reserved. " + BSD, None]
    docs = texts(spark, values)
    other = duckdb.connect()
    other.register("documents", docs.select("doc_id", "text").toPandas())
    same_rows(licenses.digest(licenses.scan_licenses(docs)), other.sql(licenses.SQL))


MIT = """MIT License

Copyright (c) 2020 Someone

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
AUTHORS BE LIABLE FOR ANY CLAIM."""
BSD = """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.

3. Neither the name of the copyright holder nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission.
"""
GPL = """This program is free software: you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation, either version 3 of the License, or
(at your option) any later version.

This program is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
GNU General Public License for more details."""
APACHE = """Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0"""
MPL = """This Source Code Form is subject to the terms of the Mozilla Public
License, v. 2.0. If a copy of the MPL was not distributed with this
file, You can obtain one at https://mozilla.org/MPL/2.0/."""


def test_licenses_of_real_texts(spark):
    hashed = lambda t: "".join(f"# {line}\r\n" for line in t.split("\n"))
    whole = {
        MIT: ("MIT", "MIT-ref,mit-grant,mit-notice,as-is"), BSD: ("BSD-3-Clause", "bsd-grant,bsd-source,bsd-binary,bsd-endorse"),
        BSD[: BSD.index("3.")].replace("1.", "(a)").replace("2.", "(b)"): ("BSD-2-Clause", "bsd-grant,bsd-source,bsd-binary"), GPL: ("GPL-3.0", "gpl-3-notice,gnu-warranty"),
        APACHE: ("Apache-2.0", "apache-grant,apache-terms,apache-copy,apache-url"), MPL: ("MPL-2.0", "mpl-2-notice,mpl-2-copy"), "This is free and unencumbered software released into the public\ndomain.": ("Unlicense", "unlicense"),
        "This work is licensed under the GNU General Public License, version\n3.": ("GPL-3.0", "GPL-3.0-ref"), "Copyright 2020 A. All rights\nreserved.": ("Proprietary", "proprietary"),
    }
    tags = {"MIT": "MIT", "Apache-2.0": "Apache-2.0", "GPL-3.0-only": "GPL-3.0", "GPL-3.0-or-later": "GPL-3.0", "GPL-2.0-only": "GPL-2.0"}
    whole |= {f"// SPDX-License-Identifier: {tag}\nint x;": (name, f"{name}-ref") for tag, name in tags.items()}
    values = [*whole, *map(hashed, whole), "int y; SPDX-License-Identifier: MITRE", BSD.replace("2. ", "2. Not known.\n")]
    got = [(r.licenses, r.sentence_ids) for r in licenses.digest(licenses.scan_licenses(texts(spark, values))).orderBy("doc_id").collect()]
    assert got == [*whole.values(), *whole.values(), ("", ""), ("", "bsd-grant,bsd-source,bsd-binary,bsd-endorse")]


#: How licenses are named without a sentence about them, and what is no license's name.
NAMED = {
    "License: MIT": "MIT", "MIT License\n\nCopyright (c) 2020 A": "MIT", "# The MIT License (MIT)\n": "MIT", "see the MIT License for details": "MIT", "Subject to the terms of the MIT License": "MIT", "This project uses the MIT license.": "MIT",
    "License: BSD-3-Clause": "BSD-3-Clause", 'license = "GPL-2.0-or-later"': "GPL-2.0", '{"license": "ISC"}': "ISC", "licensed under the GPL": "GPL", "Licensed under the GNU General Public License.": "GPL", "released under the LGPL": "LGPL",
    "Licensed under the Apache License": "Apache", "licensed under CC BY-SA": "CC-BY-SA", "SPDX-License-Identifier: Apache-2.0 OR MIT": "Apache-2.0,MIT", "// SPDX-License-Identifier: (MIT OR Apache-2.0)": "Apache-2.0,MIT", "Licensed under MIT or Apache-2.0.": "Apache-2.0,MIT",
    "Dual licensed under the MIT and GPL licenses.": "GPL,MIT", "licensed under MIT/Apache-2.0": "Apache-2.0,MIT", "SPDX-License-Identifier: GPL-2.0-only WITH Classpath-exception-2.0": "GPL-2.0", "License: MIT or Apache-2.0 or BSD-2-Clause or ISC": "Apache-2.0,BSD-2-Clause,ISC,MIT",
    "He works at MIT under license.": "", "The MIT campus uses the river.": "", "see the license for details": "", "a driving license: see page 3": "", "Apache helicopters, under the moon, see the gnu": "", "under the terms of the contract": "",
}


def test_names_of_licenses(spark):
    assert dict(zip(NAMED, [name for name, _ in found(spark, list(NAMED))], strict=True)) == NAMED


def test_named_licenses_like_sql(spark):
    import duckdb

    docs, other = texts(spark, list(NAMED)), duckdb.connect()
    other.register("documents", docs.toPandas())
    same_rows(licenses.digest(licenses.scan_licenses(docs)), other.sql(licenses.SQL))


def test_licenses_odd(spark):
    got = licenses.digest(licenses.scan_licenses(odd_documents(spark))).collect()
    assert len(got) == len(TEXTS) and {r.category for r in got} == {"none"}
    assert count(licenses.scan_licenses(no_documents(spark))) == 0
    assert licenses.scan_licenses(texts(spark, ["Released under the MIT License.\n" * 3])).first().matches[0].times == 3


# benchmark windows


def windows_of(item, size=13):
    ws = words_of(item)
    return {tuple(ws[i : i + min(size, len(ws))]) for i in range(max(1, len(ws) - size + 1))} if ws else set()


def test_contamination_like_brute_force(spark):
    rnd = random.Random(3)
    word = lambda: rnd.choice(["a", "b", "The", "É", "x1", f"r{rnd.randint(0, 60)}"])
    items = [" ".join(word() for _ in range(rnd.choice([1, 2, 5, 12, 13, 14, 20, 40]))) for _ in range(40)] + ["", "...", None]
    values = [None, ""]
    for _ in range(120):
        ws = [word() for _ in range(rnd.randint(0, 60))]
        for _ in range(rnd.randint(0, 2)):
            cut = (rnd.choice(items[:40]) or "").split()
            a = rnd.randint(0, max(0, len(cut) - 13))
            at = rnd.randint(0, len(ws))
            ws[at:at] = cut[a : a + rnd.choice([13, 13, 18, 40])]
        values.append(", ".join(ws))
    benchmark = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    docs = texts(spark, values)
    for most in (decontaminate.MAX_ANCHORS, 25):
        found = {r.doc_id: r for r in decontaminate.contamination(docs, benchmark, max_anchors=most).withColumn("n_hit", decontaminate.covered(F.col("runs"))).collect()}
        for i, t in enumerate(values):
            ws, hit, named = words_of(t), set(), set()
            for n, item in enumerate(items):
                for w in windows_of(item):
                    for p in range(len(ws) - len(w) + 1):
                        if tuple(ws[p : p + len(w)]) == w:
                            hit.update(range(p, p + len(w)))
                            named.add(str(n))
            assert (found[i].n_words, found[i].n_hit, found[i].item_ids) == (len(ws), len(hit), sorted(named)), t


def test_contamination_odd(spark):
    benchmark = spark.createDataFrame([(1, "two words"), (1, "six seven eight"), (2, None), (None, "tie tie"), (3, "")], "item_id long, text string")
    found = decontaminate.verdicts(odd_documents(spark), benchmark)
    assert sorted(str(r.doc_id) for r in found.collect()) == sorted(str(i) for i, _ in TEXTS)
    blocks = decontaminate.contamination(odd_documents(spark), benchmark, max_anchors=1)
    assert sorted(str(r.doc_id) for r in blocks.collect()) == sorted(str(i) for i, _ in TEXTS)
    got = {(r.doc_id, r.n_words): (r.n_hit, r.contaminated) for r in found.collect()}
    assert got[(9, 2)] == got[(10, 2)] == (2, True) and got[(6, 6)] == (6, True) and got[(1, 10)] == got[(None, 10)] == (3, True) and got[(2, 0)] == (0, False)
    left = decontaminate.clean(odd_documents(spark), benchmark)
    assert left.columns == odd_documents(spark).columns and sorted(str(r.doc_id) for r in left.collect()) == sorted(["2", "3", "4", "None", "5", "6", "7", "8"])
    assert count(decontaminate.verdicts(no_documents(spark), benchmark)) == 0
    assert count(decontaminate.verdicts(odd_documents(spark), benchmark.limit(0)).filter("n_hit > 0")) == 0


# fingerprints


def test_fingerprints_like_brute_force(spark):
    docs = small(spark)
    text = {r.doc_id: r.text for r in docs.collect()}
    order = sorted(text)
    after = dict(zip(order, order[1:] + order[:1], strict=True))
    errors = []
    for r in fingerprint.edited_pairs(docs).collect():
        a, b = text[r.doc_id], text[after[r.doc_id]]
        half = len(a) // 2
        edited = a[: len(a) - half] + b[:half]
        assert r.n_chars == len(a) and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        sets = [shingles_of(x) for x in (a, edited, b)]
        errors += [abs(r.near_edited - jaccard(sets[0], sets[1])), abs(r.near_next - jaccard(sets[0], sets[2]))]
        if len(sets[0] | sets[1]) <= fingerprint.K:
            assert errors[-2] < 1e-9
        inside = len(sets[0] & sets[1]) / max(1, len(sets[0]))
        assert abs(r.edited_containment - inside) < 0.25 and abs(r.n_shingles - len(sets[0])) <= 0.3 * len(sets[0])
    assert sum(errors) / len(errors) < 0.03 and max(errors) < 0.2


def test_fingerprints_merge(spark):
    rows = spark.createDataFrame([("a b c d e f g " * 40 + "x y z u v", "one two three four five six seven")], "a string, b string")
    whole = F.concat("a", F.lit("|"), F.lit("|"), "b")
    got = rows.select(fingerprint.merge(fingerprint.sketch(F.col("a")), fingerprint.sketch(F.col("b"))).alias("m"), fingerprint.sketch(whole).alias("w"), fingerprint.sketch(F.col("b")).alias("b")).first()
    assert set(got.m) <= set(got.w) and set(got.b) <= set(got.w)
    parts = rows.select(fingerprint.sketch(F.col("a")).alias("s")).unionAll(rows.select(fingerprint.sketch(F.col("b")).alias("s")))
    grouped = parts.withColumn("g", F.lit("x")).unionAll(spark.createDataFrame([([], "none"), ([5, 3], None), ([3, 4], None)], "s array<bigint>, g string"))
    assert {r.g: r.s for r in fingerprint.merge_groups(grouped, ["g"], "s").collect()} == {"x": got.m, "none": [], None: [3, 4, 5]}
    many = spark.range(5000).select((F.col("id") % 2).alias("g"), F.array("id", F.col("id") + 1).alias("s"))
    assert {r.g: r.s for r in fingerprint.merge_groups(many, ["g"], "s", 10).collect()} == {0: list(range(10)), 1: list(range(1, 11))}


def test_edited_texts_like_sql(spark, duck):
    same_rows(fingerprint.edited_pairs(small(spark)).select("doc_id", "n_chars", "edited_sha256"), duck.sql(fingerprint.EDITED_SQL))


def test_fingerprints_odd(spark):
    got = fingerprint.edited_pairs(odd_documents(spark)).collect()
    assert len(got) == len(TEXTS)
    by = {}
    for r in got:
        by.setdefault(r.doc_id, []).append(r)
    assert by[2][0].fingerprint == "" == by[3][0].fingerprint and by[2][0].near_next == 1.0 and by[9][0].fingerprint == by[10][0].fingerprint
    assert by[6][0].n_chars >= 0 and {r.fingerprint for r in by[None]} == {"", by[1][0].fingerprint}
    # 4 is followed by 5; null comes first and is followed by 1, and after 10 comes null, of whose rows the smallest beginning counts
    assert by[10][0].edited_sha256 == hashlib.sha256(b"two w").hexdigest()
    assert count(fingerprint.edited_pairs(no_documents(spark))) == 0
    alone = fingerprint.edited_pairs(texts(spark, ["a b c d e f"])).first()
    assert alone.near_next == 1.0 and alone.edited_sha256 == hashlib.sha256(b"a b c a b c").hexdigest()
    assert count(fingerprint.fingerprints(odd_documents(spark))) == len(TEXTS)


def test_successors(spark):
    ids = [None, 5, -3, 900, 5, 7]
    got = {r.i: r.next for r in fingerprint.successors(spark.createDataFrame([(i,) for i in ids], "i long"), "i").collect()}
    assert got == {None: -3, -3: 5, 5: 7, 7: 900, 900: None}
