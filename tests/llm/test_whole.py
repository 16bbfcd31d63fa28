"""Notices and leaks that are more than a line of their own."""

from __future__ import annotations

from fieldweave.llm import decontaminate, licences
from fieldweave.llm.common import table


def test_licences_within_lines_and_across_them(spark):
    mit = next(t for n, t in licences.TEMPLATES if n == "MIT" and len(t) > 100)
    words = mit.split()
    wrapped = "\n".join(" ".join(words[k : k + 9]) for k in range(0, len(words), 9))
    other = "the parts of this and of that to the end of a line with no more of it"
    rows = [
        (1, "Copyright 2020 ACME. All rights reserved.", "all-rights-reserved"),
        (2, f"{other} Licensed under the MIT License. {other}", "MIT"),
        (3, f"{other} licensed\nunder the MIT\nLicense {other}", "MIT"),
        (4, f"{other}\n{other} {wrapped} {other}\n{other}", "MIT"),
        (5, f"{other} {mit.replace('free of charge', 'without any charge')} {other}", "MIT"),
        (6, f"{other} All the rights are reserved. {other}", ""),
        (7, " ".join(["All rights reserved."] * 300), "all-rights-reserved"),
    ]
    got = {r.doc_id: r for r in licences.summary(licences.scan(spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string"))).collect()}
    assert {k: r.licences for k, r in got.items()} == {k: want for k, _, want in rows}
    assert all(got[k].best_dice == 1.0 for k in (1, 2, 3, 4, 7)) and 0.85 <= got[5].best_dice < 1


def test_leaks_of_the_given_tables_are_those_of_checking_every_passage(spark):
    docs, bench = (table(spark, "/root/testdata/sf0.001", t) for t in ("documents", "benchmark"))
    space = decontaminate.fit_documents(docs)
    pairs = lambda **kw: {(r.doc_id, r.item_id) for r in decontaminate.contaminated(docs, bench, space=space, **kw).collect()}
    got, want = pairs(), pairs(reach=-9.0)
    assert want and got <= want and len(got) >= 0.9 * len(want)
