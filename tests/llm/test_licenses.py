import pytest

from statewell.llm.licenses import CLASSES, FRAMES, HELD_FRAMES, HARD, PASSAGES, scan_licenses, templates, train
from statewell.llm.queries import op9_license_scan

#: Wordings that no frame or passage has as they stand; some are wrapped or commented.
UNSEEN = [
    ("isc", "# Permission to use, copy, modify, and/or distribute this software for any\n# purpose with or without fee is hereby granted, provided that the above\n# copyright notice and this permission notice appear in all copies."),
    ("agpl", "Offered to everybody under the GNU Affero General Public License v3"),
    ("mit", "Licensed under the terms of the MIT license"),
    ("mit", ' * THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR\n * IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,\n * FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.'),
    ("apache-2.0", "Distributed under the Apache 2.0 license"),
    ("bsd", "Redistribution and use in source and binary forms,\nwith or without modification, are permitted provided\nthat the following conditions are met:"),
    ("gpl", "This program is free software: you can redistribute it and/or modify\nit under the terms of the GNU General Public License as published by\nthe Free Software Foundation, either version 3 of the License."),
    ("lgpl", "// licensed under the GNU Lesser General Public License, see COPYING"),
    ("apache-2.0", "// Licensed under the Apache License, Version 2.0 (the \"License\");\n// you may not use this file except in compliance with the License."),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla\nPublic License, v. 2.0. If a copy was not given, ask."),
    ("cc-by", "Text and figures are licensed under the Creative Commons Attribution 4.0 International License, except where noted"),
    ("cc-by-sa", "Content is available under the CC BY-SA 4.0 unless otherwise noted"),
    ("cc-by-nc", "Our data is licensed under the CC BY-NC 4.0, contact us for other uses"),
    ("public-domain", "This is free and unencumbered software that we released into the public domain"),
    ("epl", "This program and the accompanying materials are made\navailable under the terms of the Eclipse Public License 2.0"),
    ("all-rights-reserved", "Copyright 2019 Example Press. All rights reserved."),
    ("bsd", "Use of this code is licensed under the BSD 3-Clause License found in LICENSE"),
    ("mit", "Permission is hereby granted, free of charge, to any person\nobtaining a copy of this software and associated\ndocumentation files (the Software)"),
    ("gpl", "You may use this under the GNU General Public License, version 2, at your choice"),
    ("isc", "Code is licensed under the ISC License"),
]
CLEAN = [
    "The museum licensed its pictures to a publisher for one year.",
    "He took the general road to the public school, version of events unclear.",
    "MIT researchers published a study of bees.",
    "Conditions are met when modification of the source is finished.",
    "Permission was granted to enter the park, free of noise.",
    "All rights and duties pass to the heirs.",
    "The foundation published a program for the hope of the poor.",
    "A warranty of two years covers the motor.",
]


@pytest.fixture(scope="module")
def model(spark, sf):
    return train(spark.read.parquet(f"{sf}/documents.parquet"))


def test_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    notice = {
        "Licensed under CC BY-NC 4.0.": "cc-by-nc",
        "This work is licensed under the GNU General Public License, version 3.": "gpl",
        "Licensed under the Apache License, Version 2.0.": "apache-2.0",
        "Released under the MIT License.": "mit",
        "All rights reserved.": "all-rights-reserved",
    }
    want = {(r.doc_id, i, notice[line]) for r in docs for i, line in enumerate((r.text or "").split("\n")) if line in notice}
    assert want and {(r.doc_id, r.paragraph, r.family) for r in op9_license_scan(spark, sf).collect()} == want


def test_unseen_wordings(spark, model):
    """Recall and precision over all families are 0.9 or more, wrapped or not."""
    seen = {x.lower() for c in CLASSES[1:] for x in templates(c)}
    assert not any(t.lower() in seen for _, t in UNSEEN) and not set(FRAMES) & set(HELD_FRAMES)
    rows = [(i, f"Some words.\n\n{t}\n\nmore words") for i, (_, t) in enumerate(UNSEEN)]
    rows += [(100 + i, t) for i, t in enumerate(CLEAN + HARD)]
    found = scan_licenses(spark.createDataFrame(rows, "doc_id long, text string"), model).collect()
    right = {r.doc_id for r in found if r.doc_id < 100 and r.family == UNSEEN[r.doc_id][0]}
    wrong = [(r.doc_id, r.family) for r in found if r.doc_id >= 100 or r.family != UNSEEN[r.doc_id][0]]
    assert len(right) >= 0.9 * len(UNSEEN), [UNSEEN[i] for i in range(len(UNSEEN)) if i not in right]
    assert len(wrong) <= 0.1 * len(found), wrong
    assert all(0.5 <= r.probability <= 1 and r.confirmed >= 0.6 for r in found)


def test_passages_and_odd_rows(spark, model):
    passages = [(name, t) for name, ts in PASSAGES.items() for t in ts]
    rows = [(i, f"Some words.\n\n  {t}\r\n\nmore", name) for i, (name, t) in enumerate(passages)]
    rows += [(None, None, None), (900, "", None), (901, "plain " * 9000, None), (902, "All rights reserved.\n" * 3, None), (902, "All rights reserved.\n" * 3, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, family string")
    got = sorted((r.doc_id, r.paragraph, r.family) for r in scan_licenses(df, model).collect())
    assert got[-2:] == [(902, 0, "all-rights-reserved")] * 2  # neighbours are one row, repeated rows are not
    assert sum(a == (i, 2, name) for a, (i, (name, _)) in zip(got, enumerate(passages))) >= 0.9 * len(passages)
    empty = df.limit(0)
    assert scan_licenses(empty, model).count() == 0 and train(empty).temperature > 0
