from __future__ import annotations

import math
import random
import re

from ledgerflow.llm import licenses as L

from .conftest import DOC


def norm(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.sub(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", " ", low).strip(" ")


def brute(text, threshold=0.8):
    w = norm(text).split(" ") if norm(text) else []
    places = [(i, label) for phrase, label in L.PHRASES for i in range(len(w)) if w[i:i + len(phrase.split())] == phrase.split()]
    labels, score = {label for _, label in places}, 1.0 if places else 0.0
    for label, t in L.TEMPLATES:
        own, u = set(t.split()), L.window_class(len(t.split()))
        for i in range(0, len(w), u):
            held = len(own & set(w[i:i + 2 * u]))
            if held >= math.ceil(threshold * len(own)):
                labels.add(label)
                score = max(score, held / len(own))
    at = [i for i, _ in places]
    return (len(w), len(places), min(at, default=None), max(at, default=None), ",".join(sorted({label for _, label in places})), ",".join(sorted(labels)), score)


TEXTS = ["Licensed under the Apache License, Version 2.0.", "x y\nThis work is licensed under the GNU General Public License, version 3.\nMIT LICENSE mit license",
         "Licensed under CC BY-NC 4.0.\nAll rights reserved", "cc by cc by", "the of license under", "apache\nlicense", "Released under MIT License", "mitt license", "İCC BYé cc  by",
         "redistribution and use in source and binary forms with modification", "all rights\nreserved"]


HARD_WRAPPED = {
    "bsd": "/* Redistribution and use in source and binary forms, with or without\n * modification, are permitted provided that",
    "gpl-3.0": "# This program is free software: you can redistribute it and/or modify\n# it under the terms of the GNU General Public License as published by\n# the Free Software Foundation",
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla\nPublic License, v. 2.0. If a copy",
    "mit": "Permission is hereby granted, free of charge, to any person obtaining\na copy of this software and associated",
    "lgpl-3.0": "Licensed under the GNU Lesser\nGeneral Public\nLicense, Version 3",
}


def test_hard_wrapped_notices_at_every_place(spark):
    from .conftest import words
    rng = random.Random(3)
    rows, want = [], {}
    for i, (label, notice) in enumerate(HARD_WRAPPED.items()):
        for k in range(40):
            rows.append((100 * i + k, " ".join(words(rng, k)) + "\n" + notice + "\n" + " ".join(words(rng, 50)), None, None, None))
            want[100 * i + k] = label
    got = {r.doc_id: r.labels.split(",") for r in L.scan_licenses(spark.createDataFrame(rows, DOC)).collect()}
    assert all(want[d] in got[d] for d in want)


def test_all_contained_templates_give_their_label(spark):
    text = "Permission is hereby granted free of charge to any person obtaining a copy of the software. All rights reserved."
    assert L.scan_licenses(spark.createDataFrame([(1, text, None, None, None)], DOC)).first().labels == "all-rights-reserved,mit"


def rows_of(df):
    return sorted((str(r.doc_id), r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.labels, round(r.score, 9)) for r in df.collect())


def test_against_brute_force(spark, odd_rows):
    rows = odd_rows + [(100 + i, t, None, None, None) for i, t in enumerate(TEXTS)] + [(100, TEXTS[0], None, None, None)]
    want = sorted((str(r[0]), *brute(r[1])[:-1], round(brute(r[1])[-1], 9)) for r in rows)
    assert rows_of(L.scan_licenses(spark.createDataFrame(rows, DOC))) == want


def test_empty_and_extra_columns(spark, odd_docs, clashing):
    assert rows_of(L.scan_licenses(clashing)) == rows_of(L.scan_licenses(odd_docs))
    assert L.scan_licenses(spark.createDataFrame([], DOC)).count() == 0
