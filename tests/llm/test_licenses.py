import re

import duckdb
import pyarrow as pa

from photonlake.llm import licenses

from .helpers import AWKWARD, clashing, documents


def test_known_sentences_have_a_cue_and_one_form():
    assert len(licenses.known()) == len(licenses.SENTENCES)
    assert all(re.search(licenses.CUE, s) for s in licenses.known())
    assert all(k in licenses.SENTENCES for _, rule in licenses.RULES for k in rule)


def test_rules(spark):
    s = licenses.SENTENCES
    mit = "\n".join([s["mit-grant"], "", s["mit-condition"], "", s["mit-as-is"]])
    apache = "# " + " ".join(s[k] for k in ("apache-notice", "apache-copy")).replace("except in", "except\n# in") + "\n#\n# " + s["apache-as-is"].replace("BASIS, WITHOUT", "BASIS,\n# WITHOUT") + "\n# " + s["apache-see"]
    bsd3 = s["bsd-grant"] + "\n\n1. " + s["bsd-source"] + "\n2. " + s["bsd-binary"] + "\n3. " + s["bsd-name"]
    cases = [
        (mit, "MIT", 0), (apache, "Apache-2.0", 0), (bsd3, "BSD-3-Clause", 0), (bsd3.rpartition("\n")[0], "BSD-2-Clause", 0),
        ("Words.\nReleased under the MIT License.\nMore. All rights  reserved.", "MIT,Proprietary", 0), ("licensed under cc by-nc 4.0", "CC-BY-NC-4.0", 0),
        (s["mit-condition"], "", 1), (s["mit-condition"] + "\n" + mit, "MIT", 1), ("We license nothing.", "", 0), (s["gpl-free-3"] + "\n" + s["gpl-hope"] + " " + s["gpl-see"], "GPL-3.0-or-later", 0),
        (s["mpl-notice"] + " 2.0.", "MPL-2.0", 0), ("// SPDX-License-Identifier: MIT\ncode()", "MIT", 0), ("word " * 20000 + ".\n" + s["rights"], "Proprietary", 0),
    ]
    got = licenses.license_scan(clashing(documents(spark, [t for t, _, _ in cases] + AWKWARD))).orderBy("doc_id").collect()
    for r, (t, want, left) in zip(got, cases):
        assert (r.licenses, r.n_unmatched) == (want, left), t[:80]
    assert all((r.n_sentences, r.licenses) == (0, "") for r in got[len(cases) :])
    assert licenses.license_scan(documents(spark, []).limit(0)).count() == 0


GPL = """This program is free software{0} you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation{1} either version {2} of the License, or
(at your option) any later version.

This program is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
GNU General Public License for more details."""
MPL = """This Source Code Form is subject to the terms of the Mozilla Public
License, v. 2.0. If a copy of the MPL was not distributed with this
file, You can obtain one at https://mozilla.org/MPL/2.0/."""
APACHE = """Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
See the License for the specific language governing permissions and
limitations under the License."""


def test_notices_in_their_published_lines(spark):
    notices = [(GPL.format(":", ",", 3), "GPL-3.0-or-later", 3), (GPL.format(";", ";", 2), "GPL-2.0-or-later", 3), (MPL, "MPL-2.0", 1), (APACHE, "Apache-2.0", 4)]
    cases = [(head + t.replace("\n", feed), want, n) for t, want, n in notices for head, feed in (("", "\n"), ("# ", "\n# "), ("/*\n * ", "\n * "), ("Copyright 2020 A\n", "\r\n"))]
    cases += [("Copyright 2020 A\nAll rights reserved\nLicensed under the MIT License\nfoo", "Proprietary", 1), ("A\nAll rights reserved\nB", "Proprietary", 1), ("Not a\n\nlicensed under the\n\nMIT License.", "", 0)]
    got = licenses.license_scan(documents(spark, [t for t, _, _ in cases])).orderBy("doc_id").collect()
    for r, (t, want, n) in zip(got, cases):
        assert (r.licenses, r.n_sentences, r.n_unmatched) == (want, n, 0), t


def test_every_rule_finds_its_licence(spark):
    texts = ["Intro words.\n\n" + "\n\n".join(licenses.SENTENCES[k] for k in rule) + "\n\nMore words." for _, rule in licenses.RULES]
    got = licenses.license_scan(documents(spark, texts)).orderBy("doc_id").collect()
    for r, (licence, rule) in zip(got, licenses.RULES):
        assert (r.licenses, r.n_sentences, r.n_unmatched) == (licence, len(rule), 0), rule


def test_longer_rules_come_first():
    for k, (_, rule) in enumerate(licenses.RULES):
        for _, other in licenses.RULES[k + 1 :]:
            assert not any(other[i : i + len(rule)] == rule for i in range(len(other) - len(rule) + 1)), (rule, other)


def brute(text):
    """Known sentences line by line: of those that begin at a line the longest, then on after it."""
    if not text or not re.search(licenses.CUE, text, re.I):
        return []
    text = re.sub(licenses.SPDX, r"\1.\n", text)
    text = re.sub(licenses.ADDRESS, " ", text)
    text = re.sub(licenses.WRAP, " ", text)
    lines = [licenses.normalised_text(x) for x in re.sub(licenses.STOPS, "\n\n", text).split("\n")]
    known, out, k = licenses.known(), [], 0
    while k < len(lines):
        best = None
        for end in range(k + 1, len(lines) + 1):
            if not all(lines[k:end]):
                break
            if (s := " ".join(lines[k:end])) in known:
                best = (end, known[s])
        if best:
            out.append(best[1])
        k = best[0] if best else k + 1
    return out


def test_random_notices_against_brute_force(spark):
    import random

    r, texts = random.Random(9), []
    for _ in range(250):
        parts = []
        for _ in range(r.randrange(1, 6)):
            s = r.choice(list(licenses.SENTENCES.values())) if r.random() < 0.8 else " ".join(r.choice(("We", "license", "this", "MIT", "All rights reserved", "WITHOUT", "or")) for _ in range(r.randrange(1, 7)))
            words = s.split(" ")
            for _ in range(r.randrange(3)):
                k = r.randrange(len(words))
                words[k] = r.choice(("\n", "\n * ", "\r\n", "\n\n", "\n# ")) + words[k]
            parts.append(" ".join(words))
        texts.append("".join(p + r.choice((" ", "\n", "\n\n", ". ")) for p in parts))
    got = licenses.license_scan(documents(spark, texts + AWKWARD)).orderBy("doc_id").collect()
    want = [brute(t) for t in texts + AWKWARD]
    assert [r.sentence_ids for r in got] == [",".join(w) for w in want] and sum(map(len, want)) > 300
    with duckdb.connect() as con:
        con.register("documents", pa.table({"doc_id": range(len(want)), "text": pa.array(texts + AWKWARD, pa.string())}))
        by_sql = con.sql(licenses.ORACLE_SQL["op3_license_scan"]).order("doc_id")
        assert by_sql.fetchall() == [tuple(r[c] for c in by_sql.columns) for r in got]
