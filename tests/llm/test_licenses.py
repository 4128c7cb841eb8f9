"""License notices that are wrapped, and versions that differ in one word."""

import textwrap

from strandframe.llm import licenses


def test_wrapped_notices(spark):
    rows, want = [], {}
    for i, (label, text) in enumerate(licenses.TEMPLATES):
        rows.append((i, "Some words\n\n" + textwrap.fill("x y " + text + " and so on", 30, initial_indent="# ", subsequent_indent="# ")))
        want[i] = label
    far = licenses.TEMPLATES[1][1].replace(" ", " one\ntwo ")
    rows += [(100, far), (101, None)]
    got = {r.doc_id: set(r.labels.split(",")) for r in licenses.license_scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(want[i] in got[i] for i in want), got
    assert got[100] == got[101] == {""}


def test_versions_are_told_apart(spark):
    notice = "This work is licensed under the GNU General Public License, version "
    rows = [(2, notice + "2."), (3, notice + "3."), (4, notice.replace("Public ", "Public\n") + "3")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.labels for r in licenses.license_scan(docs).collect()}
    assert got == {2: "gpl,gpl-2.0", 3: "gpl,gpl-3.0", 4: "gpl,gpl-3.0"}
    assert {r.labels for r in licenses.license_scan(docs, apart=False).collect()} == {"gpl,gpl-2.0,gpl-3.0"}


def test_words_of_a_long_line_are_no_notice(spark):
    far = "Our released notes, under no license at all, cite a paper from the institute at MIT"
    near = "notes " * 500 + "released under the MIT license" + " notes" * 500
    got = {r.doc_id: r.labels for r in licenses.license_scan(spark.createDataFrame([(1, far), (2, near), (3, "MIT License the under released")], "doc_id long, text string")).collect()}
    assert got == {1: "", 2: "mit", 3: "mit"}
