import re

from pairforge.llm import license_scan as ls


def plain(text, phrases):
    t = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", t)
    hits = [(i, label) for p, label in phrases.items() for i in range(len(w)) if w[i:i + len(p.split())] == p.split()]
    at = [i for i, _ in hits]
    return len(w), len(hits), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in hits}))


def test_base_matches_plain_search(documents, odd_docs, no_docs, spark):
    more = spark.createDataFrame([(1, "MIT license mit LICENSE Apache\nLicense"), (2, "gnu general public license; general  public license"),
                                  (3, "licensemit license mit mitlicense"), (4, "é MIT_License é")], "doc_id long, text string")
    for df in (documents, odd_docs, more):
        got = sorted(map(str, ((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in ls.scan_licenses(df).collect())))
        want = sorted(str((r.doc_id, *plain(r.text, ls.BASE_PHRASES))) for r in df.select("doc_id", "text").collect())
        assert got == want
    assert ls.scan_licenses(no_docs).count() == 0


def test_notices(spark):
    rows = [(1, "Foo. Licensed under CC BY-NC 4.0."), (2, "Released under the MIT License."), (3, "nothing here by nc cc"),
            (4, "Redistribution and use in source and binary forms, with or without modification, are permitted."),
            (5, "cc by nc"), (6, "Subject to the terms of the Mozilla Public License, v. 2.0 and licensed under the Apache License, Version 2.0"),
            (7, "general public license")]
    df = spark.createDataFrame(rows * 3 + [(i, "plain words by the way") for i in range(10, 60)], "doc_id long, text string")
    got = {r.doc_id: r for r in ls.scan_licenses(df).collect()}
    assert {i: got[i].labels for i in range(1, 8)} == {1: "cc-by-nc", 2: "mit", 3: "", 4: "bsd", 5: "", 6: "apache,mpl", 7: "gpl"}
    assert got[1].base_labels == "" and got[2].base_labels == "mit" and got[1].score > 0.9
    assert all(0 <= r.score <= 1 for r in got.values()) and got[3].score == 0 and got[7].score == 1
    assert {got[i].labels for i in range(10, 60)} == {""}


def test_notices_do_not_crowd_each_other_out(spark):
    """A notice of common words is found in a file with the many rare words of other notices."""
    bsd = "Redistribution and use in source and binary forms, with or without modification, are permitted. "
    mit = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software. "
    cc = "Licensed under CC BY-NC 4.0."
    rows = [(1, bsd + cc), (2, mit + cc), (3, mit + bsd + "Subject to the terms of the Mozilla Public License, v. 2.0. " + cc), (4, bsd + "by nc cc")]
    df = spark.createDataFrame(rows + [(i, "0 4 nc by cc under licensed") for i in range(10, 60)], "doc_id long, text string")
    got = {r.doc_id: r.labels for r in ls.scan_licenses(df).collect()}
    assert [got[i] for i in range(1, 5)] == ["bsd,cc-by-nc", "cc-by-nc,mit", "bsd,cc-by-nc,mit,mpl", "bsd"]


def test_no_python_in_the_plan(documents):
    plan = ls.scan_licenses(documents)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
