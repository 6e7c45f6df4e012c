import pytest
from edge import answer, clashing, documents

from veilmeter.llm.licences import licences

MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and
associated documentation files. The above copyright notice and this permission notice shall be included in
all copies. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND."""
BSD = """Redistribution and use in source and binary forms, with or without modification, are permitted.
Redistributions of source code must retain the above copyright notice.
Redistributions in binary form must reproduce the above copyright notice.
"""
CASES = [
    ("Some prose.\nLicensed under the Apache License, Version 2.0.", "Apache-2.0"),
    ("This work is licensed under the GNU General Public License, version 3.", "GPL"),
    ("Released under the MIT License.\nMore.", "MIT"),
    ("Licensed under CC BY-NC 4.0.\nText. Licensed under CC BY-SA 3.0.", "CC:by-nc-4.0,CC:by-sa-3.0"),
    (MIT, "MIT"),
    (BSD, "BSD-2-Clause"),
    (BSD + "Neither the name of the owner may be used to endorse or promote products.", "BSD-3-Clause"),
    ("# SPDX-License-Identifier: MPL-2.0\ncode", "SPDX:mpl-2.0"),
    ("Copyright 2020 Somebody.\nAll rights reserved.", "proprietary"),
    ("You need a licence to fish here.", "unknown"),
    ("Nothing of the kind.", ""),
    ("scum of The\nLicensed under CC BY-NC 4.0.", "CC:by-nc-4.0"),
    ("You may not use this file except in compliance with the License.\nYou may obtain a copy of the License at x",
     "Apache-2.0"),
    ("Redistributions of source code must retain the above copyright notice.", ""),  # out of its sequence
]


@pytest.fixture(scope="module")
def found(spark):
    rows = [(i, t) for i, (t, _) in enumerate(CASES)]
    return {r.doc_id: r for r in licences(spark.createDataFrame(rows, "doc_id long, text string")).collect()}


@pytest.mark.parametrize("i", range(len(CASES)))
def test_case(found, i):
    assert found[i].licences == CASES[i][1]


#: A text for each known sentence, in their order, its words parted as badly as may be.
KNOWN = (
    "SPDX-License-Identifier: MIT", "Licensed under the\napache license, version 2.0", "You may not use this file except in compliance with the\nlicense",
    "You may obtain a copy of the\nlicense at x", "See the\nlicense for the specific language governing permissions and limitations",
    "under the MIT\nlicense", "Permission\nis  hereby granted, free of charge, to any person obtaining a copy of this software",
    "The above\ncopyright notice and this permission notice shall be included in all copies", "Licensed under the GNU General Public License, version 2",
    "This program is free software; you can", "Either version 3 of the license", "This program is distributed in the hope that it will be useful, but without any\nwarranty",
    "Redistribution and use in source and binary forms, with or without modification, are permitted",
    "Redistributions of source code must retain the above copyright notice", "Redistributions in binary form must reproduce the above copyright notice",
    "Neither\nthe name of X may be used to endorse or promote products", "The software is provided \"as\nis\"",
    "This source code form is subject to the terms of the mozilla public license, v. 2.0", "Licensed under CC BY 4.0",
    "This work is released under CC0.", "Dedicated to CC0", "Dedicated to the public\ndomain", "Copyright 2020 X",
)


def test_every_known_sentence_passes_the_filter(spark):
    got = licences(spark.createDataFrame(list(enumerate(KNOWN)), "doc_id long, text string")).orderBy("doc_id").collect()
    apart = KNOWN.index("This program is free software; you can")  # a sentence of its own, cut at the semicolon
    assert [KNOWN[r.doc_id] for r in got if r.n_sentences != 1 and r.doc_id != apart] == []
    assert [r.licences for r in got[19:22]] == ["CC0-1.0"] * 3


def test_unknown_sentences_and_expressions(spark):
    wrapped = (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software, to deal in the\n"
        "Software without restriction, including the rights to use, copy and sublicense.\n"
        "The above copyright notice and this permission notice shall be included in all copies."
    )
    texts = [
        wrapped, "// SPDX-License-Identifier: (MIT OR Apache-2.0)\nand code", "SPDX-License-Identifier: MIT AND BSD-3-Clause OR CC0-1.0",
        "SPDX-License-Identifier: GPL-2.0 WITH Classpath-exception-2.0\ncode", "A licence of some kind. " + BSD,
    ]
    got = licences(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).orderBy("doc_id").collect()
    assert [(r.n_sentences, r.licences) for r in got] == [
        (3, "MIT"), (1, "SPDX:mit,SPDX:apache-2.0"), (1, "SPDX:mit,SPDX:bsd-3-clause,SPDX:cc0-1.0"), (1, "SPDX:gpl-2.0"),
        (4, "BSD-2-Clause,unknown"),
    ]


def test_a_rule_consumes_its_sentences(spark):
    text = BSD + "Neither the name of the owner may be used to endorse or promote products.\n" + BSD
    got = licences(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()[0]
    assert got.licences == "BSD-3-Clause,BSD-2-Clause" and got.n_sentences == 7


def test_edge_rows(spark):
    got = answer(licences(clashing(documents(spark))))
    assert len(got) == 12 and all(r[1:] == (0, "", "") for r in got)
    assert licences(documents(spark, [])).count() == 0
