import re
from collections import Counter

from urbanweave.llm import licenses as li

from . import cases

TEXTS = [
    "Released under the MIT License.",
    "Licensed under the Apache License, Version 2.0.",
    "This work is licensed under the GNU General Public License, version 3.",
    "Licensed under CC BY-NC 4.0.",
    "SPDX-License-Identifier: BSD-3-Clause",
    "MIT-LICENSE mit license MIT license; Apache\n\nLicense general public license",
    "submit license mit licenses xmit license",
    "mit license  mİt license Kit license",
    "Berkeley Software Distribution license, Creative Commons Attribution ShareAlike 4.0 and Unlicense",
    "mit license " * 300,
]
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
ASCII_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(text):
    words = WORD.findall((text or "").translate(ASCII_LOWER))
    found = [(i, label) for phrase, label in li.BASE for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.split()]
    places = [i for i, _ in found]
    return len(words), len(found), min(places, default=None), max(places, default=None), ",".join(sorted({label for _, label in found}))


def test_base_of_every_case(spark):
    rows = cases.ROWS + [(100 + i, t, None, None, None) for i, t in enumerate(TEXTS)]
    found = li.with_digest(li.detect(cases.table(spark, rows))).collect()
    got = Counter((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in found)
    assert got == Counter((k, *brute(t)) for k, t, *_ in rows)
    for row in found:
        assert set(filter(None, row.base_labels.split(","))) <= set(filter(None, row.labels.split(","))) and 0 <= row.score <= 1
        assert (row.score > 0) == (row.labels != "")


def test_labels_and_suppression(spark):
    rows = [(i, t, None, None, None) for i, t in enumerate(TEXTS)]
    labels = {r.doc_id: (r.labels, r.score) for r in li.with_digest(li.detect(cases.table(spark, rows))).collect()}
    assert labels[0] == ("mit", 0.75)
    assert labels[1] == ("apache,apache-2.0", 0.75)
    assert labels[2] == ("gpl,gpl-3.0", 0.75)
    assert labels[3] == ("cc-by-nc-4.0", 0.75)  # cc-by, cc-by-nc and the rest lie inside it
    assert labels[4] == ("bsd-3-clause", 1.0)
    assert labels[6] == ("", 0.0)
    assert labels[8][0] == "bsd,cc-by-sa-4.0"


def test_hundreds_of_rules():
    rules = li.signatures()
    assert len(rules) > 300 and len({(r.label, r.pattern) for r in rules}) == len(rules)
    for rule in rules:  # the keyword is a word of every match, so the prefilter loses none
        assert f" {rule.keyword} " in rule.pattern and f"(?: {rule.keyword} " not in rule.pattern


def labels_of(spark, texts):
    rows = [(i, t, None, None, None) for i, t in enumerate(texts)]
    found = {r.doc_id: (r.labels, r.score) for r in li.with_digest(li.detect(cases.table(spark, rows))).collect()}
    return [found[i] for i in range(len(texts))]


def test_capital_k_is_a_letter_and_the_kelvin_sign_is_none(spark):
    texts = ["BERKELEY SOFTWARE DISTRIBUTION LICENSE", "CREATIVE COMMONS ATTRIBUTION SHAREALIKE 4.0", "Ber\u212aeley Software Distribution License"]
    assert labels_of(spark, texts) == [("bsd", 0.25), ("cc-by-sa-4.0", 0.5), ("", 0.0)]


BODIES = {
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated": "mit",
    'granted to deal with the Software without restriction': "ncsa",
    "Permission is hereby granted, free of charge, to any person or organization\nobtaining a copy of the software": "bsl-1.0",
    "Permission to use, copy, modify, and/or distribute this software for any\npurpose with or without fee is hereby granted, provided that": "isc",
    "Permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted.\nTHE SOFTWARE IS": "0bsd",
    "# Redistribution and use in source and binary forms, with or without\n# modification, are permitted provided that": "bsd",
    "Neither the name of X nor the names of its contributors may be used to endorse or promote products derived from this software": "bsd-3-clause",
    "All advertising materials mentioning features or use of this software must display the following acknowledgement:": "bsd-4-clause",
    "The origin of this software must not be misrepresented; you must not": "zlib",
    "TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION": "apache-2.0",
    "GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or": "gpl,gpl-2.0",
    "GNU Lesser General Public\nLicense as published by the Free Software Foundation; either\nversion 2.1 of the License": "gpl,lgpl-2.1",
    "GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License": "agpl-3.0,gpl",
    "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.": "mpl-2.0",
    "This is free and unencumbered software released into the public domain.": "unlicense",
    "To the extent possible under law, Jo Doe has waived all copyright and related or neighboring rights to this work": "cc0-1.0",
}
GLUED = {
    "Licensed under GPLv3": "gpl-3.0", "under LGPLv2.1 or later": "lgpl-2.1", "(GPLv2+)": "gpl-2.0", "AGPLv3": "agpl-3.0", "Released under the LGPLv3.": "lgpl-3.0",
    "xgplv3 gplv33": "", "apache2": "apache-2.0",
}
FIELDS = {
    '{"license": "MIT", "main": "x"}': "mit", '"license": "MIT"': "mit", "License: MIT": "mit", "license = 'GPL-3.0-only'": "gpl-3.0", "License: GPL-3": "gpl-3.0",
    "license: Apache-2.0\nname: x": "apache-2.0", "license: BSD-3-Clause": "bsd-3-clause", "License: BSD": "bsd", "license: CC0-1.0": "cc0-1.0", '"license": "ISC"': "isc",
    "licenses mit": "", "license mit licenses": "", "license: Linux": "", "License: MIT\nlanguage: en": "mit", "sublicense mit x": "",
}


def test_bodies_glued_versions_and_fields(spark):
    for cases_of in (BODIES, GLUED, FIELDS):
        assert dict(zip(cases_of, [found[0] for found in labels_of(spark, list(cases_of))], strict=True)) == cases_of


def test_every_handwritten_rule_finds_its_own_words(spark):
    texts = [(label, sentence.replace("?", "").replace(" N ", " jo doe ")) for label, _, sentence, _ in li.SENTENCES]
    texts += [(label, name) for label, names in li.GLUED.items() for name in names] + [(label, f"license: {name}") for label, names in li.FIELDS.items() for name in names]
    for (label, text), (labels, _) in zip(texts, labels_of(spark, [text for _, text in texts]), strict=True):
        assert label in labels.split(","), (label, text, labels)


def test_empty_table(spark):
    assert li.with_digest(li.detect(cases.none(spark))).count() == 0


def test_no_shuffle_and_no_python(spark):
    plan = li.with_digest(li.detect(cases.table(spark, parts=1)))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "hashpartitioning" not in plan


def test_long_texts_with_many_places(spark):
    """20,000 places in one text, some inside others, as in short ones."""
    n = 20_000
    docs = spark.createDataFrame([(1, "The MIT license. Apache license 2.0! " * n)], "doc_id long, text string")
    row = li.with_digest(li.detect(docs)).first()
    one = li.with_digest(li.detect(docs.selectExpr("doc_id", "left(text, 36) as text"))).first()
    assert (row.n_words, row.n_base, row.first_word, row.last_word) == (7 * n, 2 * n, 1, 7 * n - 4)
    assert (row.labels, row.score) == (one.labels, one.score)
