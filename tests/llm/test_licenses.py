import random

import numpy as np
import pytest

from attesta.llm import licenses as li

from .conftest import DOCS


def brute(text):
    """License to containment, each template against every stretch that starts and ends with one of its shingles."""
    words = li.words_of(text)
    shingles = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    met = []
    for name, body in li.TEMPLATES:
        w = li.words_of(body)
        want = {tuple(w[i : i + 5]) for i in range(len(w) - 4)}
        at = [i for i, s in enumerate(shingles) if s in want]
        n = len(want)
        top = max((len(set(shingles[i : i + n + n // 2]) & want) / n, -i) for i in at) if at else (0, 0)
        if top[0] >= 0.8:
            first = -top[1]
            inside = [i for i in at if first <= i < first + n + n // 2]
            met.append((top[0], first, inside[-1] + 5, name))
    return {k: round(v[0], 9) for k, v in li.best(met).items()}


def test_against_every_template(make, prose, doc_rows):
    r = random.Random(6)
    texts = [None, "", "MIT License", prose(1, 9000)]
    for no, (_, body) in enumerate(li.TEMPLATES):
        texts += [body, f"{prose(no, 30)}\n{body.upper()} {prose(no + 50, 300)}", f"{body} {body}"]
        words = body.split()
        if len(words) > 30:
            words[r.randrange(len(words))] = "changed"
            texts += [f"{prose(no, 3)} {' '.join(words)}", " ".join(words[: len(words) // 2])]
    rows = [*doc_rows(texts), (None, "Released under the MIT License.", "en", "s", 1)]
    out = {}
    for x in li.licensed(make(DOCS, rows)).collect():
        out.setdefault(x["doc_id"], {})[x["license"]] = round(x["containment"], 9)
    assert out == {d: b for d, t, *_ in rows if (b := brute(t))}


HEAD = "This {} is free software{} you can redistribute it and/or modify\n# it under the terms of the GNU {} Public License as published by\n# the Free Software Foundation{} either version {} of the License, or\n# (at your option) any later version."
CLAUSES = """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

{0} Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
{1} Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
{2}
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES ARE DISCLAIMED."""
NEITHER = "Neither the name of {} nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."


@pytest.mark.parametrize(
    ("text", "license"),
    [
        (HEAD.format("program", ":", "General", ",", "3"), "GPL-3.0"), (HEAD.format("program", ";", "General", ";", "2"), "GPL-2.0"),
        (HEAD.format("library", ";", "Lesser General", ";", "2.1"), "LGPL-2.1"), (HEAD.format("library", ";", "Library General", ";", "2"), "LGPL-2.0"),
        (HEAD.format("program", ":", "Lesser General", ",", "3"), "LGPL-3.0"), (HEAD.format("program", ":", "Affero General", ",", "3"), "AGPL-3.0"),
        ("Licensed under the GNU General Public License, version 3.", "GPL-3.0"), ("This file is licensed under the GNU General Public License, version 2.", "GPL-2.0"),
        ("Our code is licensed under the GNU Lesser General Public License v2.1 or later", "LGPL-2.1"), ("Licensed under the GNU Affero General Public License, version 3.", "AGPL-3.0"),
        (CLAUSES.format("1.", "2.", ""), "BSD-2-Clause"), (CLAUSES.format("*", "*", ""), "BSD-2-Clause"),
        (CLAUSES.format("1.", "2.", "3. " + NEITHER.format("the copyright holder")), "BSD-3-Clause"), (CLAUSES.format("*", "*", "* " + NEITHER.format("Example Inc.")), "BSD-3-Clause"),
        (CLAUSES.format("1.", "2.", "3. " + NEITHER.format("the University of Somewhere in the North")), "BSD-3-Clause"),
        ("Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:", "BSD"),
        ("This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/", "EPL-2.0"),
        ("All rights reserved. This program and the accompanying materials are made available under the terms of the Eclipse Public License v1.0 which accompanies this distribution, and is available at http://www.eclipse.org/legal/epl-v10.html", "EPL-1.0"),
    ],
)
def test_real_notices_against_their_neighbours(prose, text, license):
    got = li.Scanner().scan([text, f"{prose(5, 40)} {text} {prose(6, 40)}"])
    assert [list(g) for g in got] == [[license], [license]]


def test_settings_guarantee_the_probability():
    for n in (1, 2, 4, 8, 64, 512):
        j = li.least_jaccard(n)
        bands, rows = li.settings(j)
        assert 1 - (1 - j**rows) ** bands >= li.SURE - 1e-12


def test_minhash_estimates_jaccard():
    r = np.random.default_rng(1)
    a = r.integers(0, 2**63, 300, dtype=np.uint64)
    b = np.concatenate([a[:200], r.integers(0, 2**63, 100, dtype=np.uint64)])
    same = np.mean([li._salted(a, k).min() == li._salted(b, k).min() for k in range(400)])
    assert abs(same - 0.5) < 0.1


def test_short_template_is_refused_and_empty(make):
    with pytest.raises(ValueError, match="fewer"):
        li.Scanner((("X", "too short"),))
    assert li.licensed(make(DOCS, [])).count() == 0
