from trawldex.llm import licenses, q_licenses

#: Licences of no listed family, and prose with licence words; the classifier has seen none of them.
UNLISTED = [
    "This library is distributed under the Eclipse Public License 2.0.",
    "Use of this software is governed by the Artistic License.",
    "The contents of this file are subject to the Common Development and Distribution License.",
    "Licensed under the European Union Public Licence, version 1.2.",
    "This code is licensed under the zlib license.",
    "The software is provided as is and the authors disclaim all warranties.",
]
PROSE = [
    "The mayor gave the circus permission to use the old market place for a week.",
    "Nobody knew who had reserved the table near the window.",
    "His pilot licence had expired in the spring and he did not fly again.",
    "The editor kept a copy of every letter that came in that year.",
    "They asked for permission to use the hall on the first Sunday of the month.",
    "The copyright case went to court and nobody spoke of it again.",
    "A free copy of the map lies on the table for any person who wants it.",
    "The old licence plate was still nailed to the wall of the barn.",
]


def _scanner():
    return licenses.Scanner([f"plain words of paragraph {i} about nothing in particular" for i in range(300)])


def test_held_out_paragraphs():
    s = _scanner()
    texts = {
        "apache": "See notes. Licensed under the Apache License, Version 2.0. Thanks.",
        "mit": "RELEASED UNDER THE MIT LICENSE.",
        "gpl": "This work is licensed under the GNU General Public License, version 3, or later.",
        "cc": "licensed under cc by-nc 4.0",
        "reserved": "Copyright 2020 Someone. All rights reserved.",
    }
    for family, text in texts.items():
        n, found = s.scan([f"first paragraph about nothing\n\n{text}".encode()])[0]
        assert n == 2 and [(f["paragraph"], f["family"]) for f in found] == [(1, family)], (family, found)


def test_clean_and_unknown():
    s = _scanner()
    assert s.scan([b"", b"\n \n", b"plain words about nothing in particular"]) == [(0, []), (0, []), (1, [])]
    assert [f["family"] for f in s.scan([b"Licensed under the Something Else License."])[0][1]] == ["unknown"]
    for text in UNLISTED:
        n, found = s.scan([text.encode()])[0]
        assert n == 1 and {f["family"] for f in found} == {"unknown"}, (text, found)
    # prose with words of licences, unseen: mostly left alone, and never given a family
    found = [s.scan([text.encode()])[0][1] for text in PROSE]
    assert sum(not f for f in found) >= 0.75 * len(PROSE) and {x["family"] for f in found for x in f} <= {"unknown"}, found


def test_query_finds_planted_lines(spark, sf):
    lines = {"Licensed under the Apache License, Version 2.0.": "apache", "Released under the MIT License.": "mit", "Licensed under CC BY-NC 4.0.": "cc", "All rights reserved.": "reserved", "This work is licensed under the GNU General Public License, version 3.": "gpl"}
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = {r.doc_id: r for r in q_licenses.op5_license_scan(spark, sf).collect()}
    assert set(rows) == set(docs)
    for i, text in docs.items():
        want = sorted({f for line, f in lines.items() if line in (text or "").split("\n")})
        assert rows[i].families == ",".join(want), (i, want, rows[i])


def test_edges(spark):
    docs = spark.createDataFrame([(1, None, 1), (2, "", 1), (2, "All rights reserved.\nAll rights reserved.", 1)], "doc_id long, text string, licences int")
    rows = sorted((r.doc_id, r.n_paragraphs, len(r.licences)) for r in licenses.scan(docs, licenses.train(docs)).collect())
    assert rows == [(1, 0, 0), (2, 0, 0), (2, 2, 2)]
    assert licenses.scan(docs.limit(0), licenses.train(docs.limit(0))).count() == 0


def test_statements_inside_long_paragraphs():
    s = _scanner()
    prose = [f"word{(7 * i) % 61} of{(5 * i) % 23} text{i % 17}" for i in range(140)]
    for family, templates in licenses.TEMPLATES.items():
        for t in templates:
            for k in (10, 40, 400):
                words = " ".join(prose).split()[:k]
                for cut in range(0, k + 1, max(1, k // 7)):
                    n, found = s.scan([" ".join([*words[:cut], t, *words[cut:]]).encode()])[0]
                    assert n == 1 and [(f["paragraph"], f["family"]) for f in found] == [(0, family)], (t, k, cut, found)


def test_one_paragraph_of_two_licences():
    filler = " ".join(f"plain{i % 31} words{i % 7}" for i in range(60))
    text = f"{filler} Released under the MIT License. {filler} All rights reserved. {filler}"
    assert [(f["paragraph"], f["family"]) for f in _scanner().scan([text.encode()])[0][1]] == [(0, "mit"), (0, "reserved")]
    assert _scanner().scan([filler.encode()]) == [(1, [])]


def test_training_sample_of_whole_distinct_paragraphs(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(licenses, "Scanner", seen.append)
    long = " ".join(f"w{i}" for i in range(1000))
    copies = [(i, "the same line\n" * 40) for i in range(20)]
    docs = spark.createDataFrame([*copies, (30, long), (31, "another line"), (32, "Copyright of a line")], "doc_id long, text string")
    licenses.train(docs)
    assert seen.pop() == sorted(["the same line", "another line", long])
    licenses.train(docs, sample=2)
    assert len(set(seen[0])) == len(seen.pop()) == 2
    licenses.train(docs, sample_bytes=100)
    assert seen.pop() == ["another line", "the same line"]


def test_recall_of_held_out_templates():
    """A statement that the classifier has never seen, whole, is still seen as a licence."""
    prose = [f"plain words of paragraph {i} about nothing in particular" for i in range(300)]
    seen = total = 0
    for fold in range(3):
        k = -1
        learned, held = {}, []
        for family, statements in licenses.TEMPLATES.items():
            learned[family] = []
            for t in statements:
                k += 1
                (held if k % 3 == fold else learned[family]).append(t)
        s = licenses.Scanner(prose, learned)
        total += len(held)
        seen += sum(bool(s.scan([t.encode()])[0][1]) for t in held)
    assert seen >= 0.9 * total, (seen, total)


def test_very_long_text_counts_every_paragraph():
    s = _scanner()
    text = ("plain words of a paragraph about nothing in particular\n" * 20_000 + "Released under the MIT License.\n").encode()
    n, found = s.scan([text])[0]
    assert n == 20_001 and [(f["paragraph"], f["family"]) for f in found] == [(20_000, "mit")]


def test_query_against_brute_force(spark, sf):
    """Counts of paragraphs, and licences one text at a time by the same scanner."""
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    s = licenses.train(docs)
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    for r in q_licenses.op5_license_scan(spark, sf).collect():
        lines = [x for x in texts[r.doc_id].split("\n") if licenses._words(x.encode())]
        alone = [{f["family"] for f in s.scan([x.encode()])[0][1]} for x in lines]
        assert r.n_paragraphs == len(lines)
        assert (r.n_license, r.n_unknown) == (sum(map(bool, alone)), sum("unknown" in a for a in alone)), r
        assert r.families == ",".join(sorted(set().union(*alone, set()) - {"unknown"}))
