"""The licence scan against a plain version, on the supplied documents and on odd ones."""

import re

import duckdb

from sinoflow.llm import licenses, queries


def plain(text):
    t = text or ""
    units = {t, *re.split(r"[\r\n]+", t), *re.split(r"[\r\n]+|(?<=[.;:!?])\s+", t), *re.split(r"(?:\r?\n[ \t]*){2,}", t)}
    known = [(name, licenses.bigrams_of(x)) for name, x in licenses.TEMPLATES]
    found = []
    for a in map(licenses.bigrams_of, units):
        best = max((2 * len(a & b) / (len(a) + len(b)), name) for name, b in known)
        if best[0] >= licenses.DICE:
            found.append(best)
    best = max(found, default=(0.0, None))
    return best[1], round(best[0], 9), sorted({n for _, n in found})


def test_as_plain(spark, small):
    texts = duckdb.sql(f"SELECT doc_id, text FROM '{small}/documents.parquet'").fetchall()
    full = "\n".join(licenses._MIT[k : k + 70] for k in range(0, len(licenses._MIT), 70))
    notice = "\n".join(re.findall(r".{1,60}(?:\s|$)", licenses._MIT))
    odd = [None, "", "licence", "LICENCED UNDER CC BY-NC 3.0", "# Released under the MIT Licence", "Some words. Released under the MIT License. More of them.", f"Copyright\n\n{notice}\n\nThe end", full, "mit " * 500, licenses._APACHE, "This work is licensed under the GNU General Public License, version 2.\nReleased under the MIT License."]
    odd = [(None if k % 3 == 0 else 7, t) for k, t in enumerate(odd)]
    docs = spark.createDataFrame(texts + odd, "doc_id long, text string")
    got = sorted((str(r["doc_id"]), r["license"] or "", round(r["score"], 9), r["licenses"]) for r in licenses.scan(docs).collect())
    want = [(d, *plain(t)) for d, t in texts + odd]
    assert got == sorted((str(d), n or "", s, x) for d, n, s, x in want)
    assert plain(odd[6][1])[0] == plain(odd[5][1])[0] == plain(odd[4][1])[0] == "MIT" and plain(odd[10][1])[2] == ["GPL-2.0", "MIT"]


def test_finds_the_licence_lines(spark, small):
    has = {d for d, t in duckdb.sql(f"SELECT doc_id, text FROM '{small}/documents.parquet'").fetchall() if re.search(r"licen[sc]e|licensed", t or "", re.I)}
    assert has and {r["doc_id"] for r in queries.op5_licenses(spark, small).where("license is not null").collect()} == has


def test_licences_of_like_wording_are_told_apart(spark):
    wanted = [(name, text) for name, text in licenses.TEMPLATES if name in ("BSD-2-Clause", "BSD-3-Clause", "ISC", "0BSD", "Zlib", "Unlicense", "BSL-1.0", "CC0-1.0", "EPL-2.0", "MIT")]
    lines = lambda t: re.sub(r"(.{1,70})(?:\s|$)", r"\1\n", t)
    docs = spark.createDataFrame([(k, f"Copyright 2020 Somebody\n\n{lines(t)}") for k, (_, t) in enumerate(wanted)], "doc_id long, text string")
    got = {r["doc_id"]: r["license"] for r in licenses.scan(docs).collect()}
    assert got == {k: n for k, (n, _) in enumerate(wanted)}


def test_empty_table_and_clashing_names(spark):
    docs = spark.createDataFrame([(1, "Released under the MIT License.", "own", "own", 1.0), (None, None, "own", "own", 1.0)], "doc_id long, text string, license string, t string, score double")
    assert {(r["doc_id"], r["license"], r["score"]) for r in licenses.scan(docs).collect()} == {(1, "MIT", 1.0), (None, None, 0.0)}
    assert licenses.scan(docs.limit(0)).count() == 0
