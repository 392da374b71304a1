"""Base phrases against a scan of the words, passages with edits."""

import re

import duckdb
import pytest
from llm_fixtures import make_docs, no_docs, odd_docs  # noqa: F401
from pulsepanel.llm import license_scan as ls
from pulsepanel.llm.queries import sql_licenses

BASE = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by",
        "mit license": "mit"}


def words_of(text):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text)


def base(text):
    words = words_of(text)
    places = [(i, label) for phrase, label in BASE.items() for i in range(len(words))
              if words[i:i + len(phrase.split())] == phrase.split()]
    starts = [i for i, _ in places]
    return (len(words), len(places), min(starts, default=None), max(starts, default=None),
            ",".join(sorted({label for _, label in places})))


def scan(docs):
    return ls.scan_licenses(docs).collect()


TEXTS = ["MIT License", "cc-by cc by CC BY 4.0", "mit license mit license", "GNU General Public License, v3",
         "gnu general public licence", "apache", "license mit", "The Apache\nLicense... apache license!",
         "Kgpl mit licensK", "cc", "", None, " \t", "İ cc by É mit license", "x" * 9000 + " mit license"]


def test_base_phrases(make_docs):
    got = {r.doc_id: r for r in scan(make_docs(*enumerate(TEXTS)))}
    for i, t in enumerate(TEXTS):
        r = got[i]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == base(t), t
        assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(","))
        assert 0 <= r.score <= 1 and (r.n_base == 0 or r.score == 1)


PASSAGE, LABEL = ls.PASSAGES[3]


@pytest.mark.parametrize("edit,found", [
    (lambda w: w, True), (lambda w: w[:9] + ["inserted", "words"] + w[9:], True),
    (lambda w: w[:8] + w[9:], True), (lambda w: w[: len(w) // 3], False), (lambda w: w[::-1], False),
    (lambda w: [x for v in w for x in (v, "and")], False)])
def test_passages(make_docs, edit, found):
    text = "before it " + " ".join(edit(PASSAGE.split())).upper() + " after it"
    (r,) = scan(make_docs((1, text)))
    assert (LABEL in r.labels.split(",")) == found
    assert r.n_base == 0 and r.base_labels == ""
    if found:
        span = next(s for s in r.spans if s["label"] == LABEL)
        assert span["first"] == 2 and span["last"] == len(edit(PASSAGE.split())) + 1


GNU = ("This program is free software: you can redistribute it and/or modify it under the terms of "
       "the GNU{} General Public License as published by the Free Software Foundation")
CC = "This work is licensed under a Creative Commons {} International License."


def test_licenses_that_share_a_passage(make_docs):
    nc = CC.format("Attribution-NonCommercial-{}")
    mit, apache, mpl = (ls.PASSAGES[i][0] for i in (0, 1, 5))
    cases = [
        (GNU.format(""), "gpl", 1), (GNU.format(" Lesser"), "lgpl", 1), (GNU.format(" Affero"), "agpl", 1),
        (GNU.format(" Library"), "lgpl", 1),
        (GNU.format(" Affero") + ". " + GNU.format(" Lesser"), "agpl,lgpl", 1),
        (GNU.format("").replace("terms of", "terms of version 2 of"), "gpl", 1),
        (CC.format("Attribution 4.0"), "cc-by", 1),
        ("Licensed under the Creative Commons Attribution 3.0 Unported License", "cc-by", 1),
        (CC.format("Attribution-NonCommercial 4.0"), "cc-by-nc", 1),
        (CC.format("Attribution-ShareAlike 4.0"), "cc-by-sa", 1),
        (nc.format("NoDerivatives 4.0"), "cc-by-nc-nd", 1),
        (nc.format("ShareAlike 3.0"), "cc-by-nc-sa", None),
        (CC.format("Attribution-Share Alike 4.0"), "cc-by-sa", 1),
        (CC.format("Sampling Plus 4.0"), "", None),
        (mit, "mit", 1), (mit.replace("deal in", "deal with"), "", 14 / 27),  # words of bsl
        (apache, "apache", 1), (apache.replace("apache", "educational community"), "", None),
        (mpl, "mpl", 1), (mpl.replace("mozilla", "openldap"), "", None)]
    got = {r.doc_id: r for r in scan(make_docs(*[(i, c[0]) for i, c in enumerate(cases)]))}
    for i, (text, labels, score) in enumerate(cases):
        r = got[i]
        assert r.labels == labels, text
        assert score is None or r.score == pytest.approx(score), text
        assert sorted({s["label"] for s in r.spans or []}) == [x for x in labels.split(",") if x], text


def test_a_passage_has_its_label_alone(make_docs):
    got = {r.doc_id: r for r in scan(make_docs(*enumerate(p for p, _ in ls.PASSAGES)))}
    assert [(got[i].labels, got[i].score) for i in range(len(got))] == [(x, 1) for _, x in ls.PASSAGES]


def test_sql_agrees_on_notices(make_docs):
    notices = [p for p, _ in ls.PASSAGES] + [x for x in TEXTS]
    notices += [GNU.format(x) for x in ("", " Lesser", " Library", " Affero", " Simple")]
    notices += [CC.format(x + v) for x in ("Attribution", "Attribution-NonCommercial", "Attribution-ShareAlike",
                                           "Attribution-NonCommercial-NoDerivatives", "Sampling Plus")
                for v in (" 4.0", " 3.0", "")]
    notices += [p.replace(a, b) for p, _ in ls.PASSAGES for a, b in (
        ("deal in", "deal with"), ("apache", "educational community"), ("mozilla", "x"), (" the ", " "))]
    notices += [" ".join(notices[i] or "" for i in pair) for pair in ((0, 2), (9, 11), (20, 21), (3, 3))]
    docs = make_docs(*enumerate(notices))
    con = duckdb.connect()
    con.register("documents", docs.select("doc_id", "text").toPandas())
    want = con.execute(sql_licenses()).fetchall()
    columns = [c[0] for c in con.description]
    got = [tuple(r) for r in ls.scan_licenses(docs).select(*columns).collect()]
    assert sorted(map(str, got)) == sorted(map(str, want))


def test_passages_far_apart_are_separate_spans(make_docs):
    (r,) = scan(make_docs((1, " ".join([PASSAGE, "filler " * 50, PASSAGE]))))
    assert [s["label"] for s in r.spans] == [LABEL, LABEL]


def test_odd_rows(odd_docs):
    rows = odd_docs.collect()
    got = scan(odd_docs)
    assert sorted((str(r.doc_id), r.n_words) for r in got) == sorted(
        (str(r.doc_id), len(words_of(r.text))) for r in rows)


def test_empty(no_docs):
    assert ls.scan_licenses(no_docs).count() == 0


def test_plan_is_native(make_docs):
    plan = ls.license_hits(make_docs((1, "mit license")).limit(1))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan and "ArrowEval" not in plan
