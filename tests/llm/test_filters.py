"""Operators 1, 2, 5, 7 and 8 against plain versions."""

import random

import brute
from chemscore.llm import decontaminate, license_scan, secret_scan, toxicity, url_filter

from helpers import lines

WORDS = ["a", "b", "c", "Dog", "é", "x1"]


def prose(r, n, words=WORDS):
    return " ".join(r.choice(words) for _ in range(n))


def test_decontaminate_against_brute_force(spark, frame):
    r = random.Random(5)
    items = [(i, prose(r, n)) for i, n in enumerate([0, 1, 3, 9, 9, 10, 11, 25, 40, 40])]
    items += [(90, items[8][1]), (90, items[8][1]), (None, prose(r, 12)), (91, None)]
    docs = [(i, prose(r, r.randint(0, 60))) for i in range(60)]
    docs += [(100 + i, prose(r, 5, ["q"]) + " " + items[k][1].upper() + ", " + prose(r, 5, ["z"]))
             for i, k in enumerate((3, 5, 6, 7, 8, 9, 8))]
    docs += [(None, items[7][1]), (1, None), (2, ""), (3, "...!"), docs[62], docs[62], (62, "other text")]
    docs += [(200, "w " * 9000 + items[8][1] + " w" * 50)]
    bench = spark.createDataFrame([(*i, "x") for i in items], "item_id long, text string, words string")
    got = decontaminate.scan(frame(docs), bench, block=64)
    assert lines(got) == sorted(brute.decontaminate(docs, items), key=str)
    assert lines(decontaminate.scan(frame(docs[:40]), bench)) == sorted(brute.decontaminate(docs[:40], items), key=str)


def test_decontaminate_shuffled_and_empty(spark, frame, monkeypatch):
    docs, items = [(1, "one two three four five six seven eight nine ten eleven"), (2, "x")], \
        [(5, "two three four five six seven eight nine ten eleven")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    monkeypatch.setattr(decontaminate, "small", lambda df: df)   # the way beyond the broadcast
    assert lines(decontaminate.scan(frame(docs), bench)) == sorted(brute.decontaminate(docs, items), key=str)
    none = bench.limit(0)
    assert [r.contaminated for r in decontaminate.scan(frame(docs), none).collect()] == [False, False]
    assert decontaminate.scan(frame([]), bench).count() == 0


def test_urls(spark):
    urls = [None, "", "no scheme", "http://", "HTTP://A.Example.NET/en/x?y#z", "x://example.net/EN/", "http://net",
            "http://net/", "http://mynet/", "ftp://a.org/fr/", "http://org/fr", "http://b.example.com/de/?q://net/",
            "a://b?c/d", "a://b#c://net/", "http://Ünet/ä", "http://example.com/de", "x" * 5000 + "://net/" + "y" * 5000]
    rows = [(i, u, "h") for i, u in enumerate(urls)] + [(None, "http://net/", "h"), (3, "http://", "h"), (3, "http://", "h")]
    pages = spark.createDataFrame(rows, "page_id long, url string, host string")
    rules = spark.createDataFrame([], "rule_id long, rarest string, rule_tokens array<string>, confidence double, support double")
    want = []
    for i, u, _ in rows:
        host, path = brute.split_url(u)
        rule, verdict = brute.base_rule(host, path)
        want.append((i, host, path, rule, verdict or "allow", None))
    assert lines(url_filter.judge(pages, rules)) == sorted(want, key=str)


def test_mined_rules_fire(spark):
    rows = [(i, f"http://s{i % 7}.example.com/{'spam' if i % 3 == 0 else 'ok'}/p{i}?ref=1", None) for i in range(300)]
    pages = spark.createDataFrame([*rows, rows[0]], "page_id long, url string, html string")
    labels = spark.createDataFrame([(i, int(i % 3 != 0), 0) for i in range(0, 300, 2)] + [(None, 0, 1), (0, 0, None)],
                                   "doc_id long, quality int, toxic int")
    rules = url_filter.mine(pages, labels, min_support=0.05, min_confidence=0.8)
    kept = [(r.rarest, sorted(r.rule_tokens)) for r in rules.collect()]
    assert ("path:spam", ["path:spam"]) in kept
    assert all("path:spam" in t for _, t in kept) and len(kept) == 1     # longer ones are no more confident
    got = {r.page_id: r.verdict for r in url_filter.judge(pages, rules).collect()}
    assert got == {i: "block" if i % 3 == 0 else "allow" for i in range(300)}
    assert url_filter.mine(pages, labels.limit(0)).count() == 0


def test_chance_gives_no_rules_and_common_folders_cost_little(spark):
    r = random.Random(3)
    deep = "/".join(f"part{chr(97 + i)}" for i in range(20))               # twenty tokens that always stand together
    rows = [(i, f"http://s{r.randrange(9)}.example.com/{deep}/{r.choice('abcdefgh')}?{r.choice('xyz')}=1") for i in range(600)]
    pages = spark.createDataFrame(rows, "page_id long, url string")
    noise = spark.createDataFrame([(i, int(r.random() < 0.75), 0) for i in range(600)], "doc_id long, quality int, toxic int")
    assert url_filter.mine(pages, noise).count() == 0
    told = spark.createDataFrame([(i, int("/a?" not in u), 0) for i, u in rows], "doc_id long, quality int, toxic int")
    kept = [sorted(x.rule_tokens) for x in url_filter.mine(pages, told).collect()]
    assert kept == [["path:a"]]
    few = spark.createDataFrame([(i, int(i >= 19), 0) for i in range(600)], "doc_id long, quality int, toxic int")
    assert url_filter.mine(pages, few).count() == 0                        # 19 blocked pages are too few for any rule


LICENSES = [
    None, "", "MIT License", "the mit  license, MIT-License; Apache License. General Public License v3",
    "xmit license mit licenses", "Licensed under the Apache License, Version 2.0. You may not use this file except in "
    "compliance with the License.", "Licensed under CC BY-NC 4.0.", "This work is licensed under the GNU General Public "
    "License, version 3.", "free and unencumbered software released into the public domain", "é mit license é",
    "mit license " * 5000, "general public", "public license general",
]


def test_license_base_against_brute_force(frame):
    r = random.Random(2)
    texts = LICENSES + [prose(r, 40, ["mit", "license", "apache", "general", "public", "x"]) for _ in range(60)]
    docs = [*enumerate(texts), (None, "mit license"), (2, "MIT License"), (2, "MIT License")]
    got = license_scan.scan(frame(docs)).collect()
    assert sorted((tuple(r[:6]) for r in got), key=str) == \
        sorted(((i, *brute.license_base(t)) for i, t in docs), key=str)
    by = {r.doc_id: r for r in got}
    assert (by[6].labels, by[7].labels, by[8].labels) == ("cc-by-nc", "gpl", "unlicense")
    assert all(set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) and 0 <= r.score <= 1 for r in got)
    assert by[0].score == 0 and license_scan.scan(frame([])).count() == 0


VERBATIM = {
    "mit": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and
        associated documentation files (the "Software"), to deal in the Software without restriction, including""",
    "apache": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in
        compliance with the License. You may obtain a copy of the License at""",
    "lgpl": """This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser
        General Public License as published by the Free Software Foundation; either version 2.1 of the License""",
    "bsd": """Redistribution and use in source and binary forms, with or without modification, are permitted provided
        that the following conditions are met:""",
    "mpl": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL",
    "isc": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is
        hereby granted, provided that""",
    "unlicense": "This is free and unencumbered software released into the public domain.",
    "cc-by": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
}


def test_license_templates_stand_in_the_verbatim_texts(frame):
    docs = [(i, f"x y {t} z") for i, t in enumerate(VERBATIM.values())]
    got = {r.doc_id: r for r in license_scan.scan(frame(docs)).collect()}
    for i, label in enumerate(VERBATIM):
        assert label in got[i].labels.split(",") and got[i].score == 1, label
        ws = license_scan.words(VERBATIM[label])
        for t in (license_scan.words(t) for known, _, t in license_scan.TEMPLATES if known == label):
            assert any(ws[k:k + len(t)] == t for k in range(len(ws))), label


def test_license_with_a_word_more_or_less():
    index = license_scan.LicenseIndex(1, {})
    for label, key, template in license_scan.TEMPLATES:
        t, k = template.split(), key.split()
        at = next(i for i in range(len(t)) if t[i:i + len(k)] == k)
        for i in range(len(t) + 1):
            if not at < i < at + len(k):
                assert label in index.scan(" ".join([*t[:i], "qq", *t[i:]]))[3], (template, i)
            if i < len(t) and not at <= i < at + len(k):
                assert label in index.scan(" ".join([*t[:i], *t[i + 1:]]))[3], (template, i)
        assert index.scan(" ".join(["qq", *k, "qq"]))[3] <= {label, "apache", "gpl"}
    assert index.scan("Licensed under a Creative Commons Attribution-NonCommercial 4.0 International License")[3] == set()


def test_license_postings_are_intersected_without_loss():
    index = license_scan.LicenseIndex(1, {})
    grant = license_scan.words(VERBATIM["bsd"])
    assert [p for p, _ in index.places(grant)] == [p for p, x in enumerate(index.patterns) if x[0] == "bsd"]
    assert list(index.places(license_scan.words("use binary forms of it"))) == []      # few words meet the key word
    everywhere = license_scan.LicenseIndex(1, {})
    everywhere.least = [1] * len(everywhere.least)
    r = random.Random(8)
    for _ in range(3000):
        text = []
        for label, key, template in r.sample(license_scan.TEMPLATES, 2):
            t, k = template.split(), key.split()
            at = next(i for i in range(len(t)) if t[i:i + len(k)] == k)
            lost = r.sample([i for i in range(len(t)) if not at <= i < at + len(k)], min(r.randint(0, 8), len(t) - len(k)))
            for i, w in enumerate(t):
                if not at < i < at + len(k):
                    text += ["qq"] * r.choice([0, 0, 0, 0, 1, 3])
                text += [] if i in lost else [w]
        assert index.scan(" ".join(text)) == everywhere.scan(" ".join(text))


SECRETS = [
    None, "", "password=hunter2hunter2", "password=short token=abcdefgh", "secret=token: abcdefghij",
    "PassWd : \"ABCDEFGH\" api_key=12345678 apikey='1234567' API-KEY=12345678", "AKIA" + "B" * 12, "AKIA" + "B" * 11,
    "xAKIAAKIA" + "C" * 16 + " AKIA", "é日 token=" + "f0" * 20 + " 😀 " + "0" * 31 + "g" + "a" * 32,
    "secret == abcdefghi", "token=token=token=abc", "password  =  'x'", "0" * 40 + "A" + "b" * 33,
    "tok en=abcdefgh", "token=abcdefgh " * 300, "a" * 100_000,
]


def test_secrets_against_brute_force(frame):
    r = random.Random(4)
    bits = ["password", "token", "=", ":", " ", "'", "abcdefgh", "AKIA", "QWERTYUIOPAS", "0f" * 16, "é", "\n", "secret", "api_key"]
    texts = SECRETS + ["".join(r.choice(bits) for _ in range(20)) for _ in range(150)]
    docs = [*enumerate(texts), (None, SECRETS[2]), (2, SECRETS[2]), (2, "plain")]
    got = secret_scan.digest(secret_scan.find(frame(docs), secret_scan.BASE_RULES))
    assert lines(got) == sorted(((i, *brute.secrets(t)) for i, t in docs), key=str)
    more = secret_scan.digest(secret_scan.find(frame(docs)))
    assert [r[:5] for r in lines(more)] == [r[:5] for r in lines(got)]
    assert secret_scan.find(frame([])).count() == 0


def test_more_kinds_and_masks(frame):
    text = "é -----BEGIN RSA PRIVATE KEY----- ghp_" + "Zq" * 18 + " x password=ghp_" + "Yw" * 18
    found = secret_scan.find(frame([(1, text), (2, "clean"), (3, None)]))
    kept = {r.doc_id: r for r in found.withColumn("m", secret_scan.mask(found.text, found.secret_spans)).collect()}
    assert [s.kind for s in kept[1].secret_spans] == ["private_key", "github", "assign", "github"]
    assert kept[1].m == "é [private_key] [github] x [assign]"
    assert (kept[2].m, kept[3].m) == ("clean", None)
    assert kept[1].rep == "rep"                                   # other columns stay


def test_trigram_queries():
    q = secret_scan.trigram_query
    assert q("[0-9a-f]+") == [] and q("a?b?c?") == [] and q("abc|[0-9]+") == []
    assert q("AKIA[A-Z0-9]+") == [frozenset({"aki", "kia"})]
    assert set(q(r"(token|api_?key)\x20*=")) == {frozenset({"tok", "oke", "ken"}), frozenset(
        {"api", "pi_", "i_k", "_ke", "key"}), frozenset({"api", "pik", "ike", "key"})}


BAD = ["idiot", "moron", "scum"]


def toxic_table(frame, n=400, seed=1):
    r = random.Random(seed)
    clean = ["the", "of", "house", "tree", "walk", "green", "water", "idol", "more"]
    rows, labels = [], []
    for i in range(n):
        bad = i % 4 == 0
        w = [r.choice(clean) for _ in range(r.randint(10, 200))]
        if bad:
            for _ in range(3):
                w.insert(r.randrange(len(w)), r.choice(BAD))
        rows.append((i, " ".join(w)))
        labels.append((i, int(bad)))
    return rows, labels


def test_toxicity(spark, frame):
    rows, labels = toxic_table(frame)
    extra = [(1000, "the 1d10t walks"), (1001, "you m\u043er\u043en and SCUM!"), (1002, None), (1003, ""), (None, "tree"),
             (1004, "tree " * 50_000), (1005, "ｉｄｉｏｔ ｉｄｉｏｔ")]
    lab = spark.createDataFrame([*labels, (0, 1), (None, 1), (3, None)], "doc_id long, toxic int")
    lexicon = toxicity.fit(frame(rows + extra), lab)
    got = {r.doc_id: r for r in toxicity.score(frame(rows + extra), lexicon).collect()}
    assert all(got[i].predicted == t for i, t in labels if got[i].held_out) and any(r.held_out for r in got.values())
    assert all(got[i].held_out == brute.held_out(i) for i in got)
    assert [got[i].predicted for i in (1000, 1001, 1002, 1003, None, 1004, 1005)] == [1, 1, 0, 0, 0, 0, 1]
    assert all(0 <= r.score <= 1 and (r.score >= 0.5) == bool(r.predicted) for r in got.values())
    kept = toxicity.keep_clean(frame(rows), lexicon)
    assert {r.doc_id for r in kept.collect()} == {i for i, t in labels if not t} and kept.columns == frame([]).columns


def test_toxicity_exceptions_and_empty(spark, frame):
    lex = toxicity.Lexicon({" trash ": 5.0, " tras": 5.0}, (2.0, 0.5))
    assert lex.score("trash people") > 0.5 > lex.score("the trash can stands there")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    lexicon = toxicity.fit(frame([(1, "x")]), none)
    assert [r.predicted for r in toxicity.score(frame([(1, "x"), (2, None)]), lexicon).collect()] == [0, 0]
    assert toxicity.score(frame([]), lexicon).count() == 0


def test_held_out_rows_teach_nothing(spark, frame):
    rows, labels = toxic_table(frame, 200)
    flipped = [(i, 1 - t) if brute.held_out(i) else (i, t) for i, t in labels]
    fits = [toxicity.fit(frame(rows), spark.createDataFrame(x, "doc_id long, toxic int")) for x in (labels, flipped)]
    assert fits[0].weights == fits[1].weights and fits[0].curve == fits[1].curve


def test_toxicity_learns_a_wide_vocabulary(spark):
    r = random.Random(21)
    word = lambda: "".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(9))
    plain, insults = [word() for _ in range(400)], [word() for _ in range(150)]
    docs = [(i, " ".join([r.choice(plain) for _ in range(6)] + [insults[i % 150]] * (i < 12_000))) for i in range(36_000)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(8)
    labels = spark.createDataFrame([(i, int(i < 12_000)) for i, _ in docs], "doc_id long, toxic int")
    held = toxicity.score(df, toxicity.fit(df, labels)).where("held_out")
    found = {(r.toxic, r.predicted): r["count"] for r in held.join(labels, "doc_id").groupBy("toxic", "predicted").count().collect()}
    assert found[1, 1] >= 2000 and found.get((1, 0), 0) <= 20 and found.get((0, 1), 0) <= 20, found
