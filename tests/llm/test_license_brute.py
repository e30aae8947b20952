"""Labels, suppression and score against a plain reading of the rules, on long texts of many detections too."""

import random
import re

from noctua.llm import license_scan as ls

RULES = [(k, w, re.compile(p) if "(?<=" not in p else None, x, c) for k, w, p, x, c in ls.rules()]


def brute(text):
    words = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    s = " " + " ".join(words) + " "
    found = [(m.start(), m.end(), k, x, c) for k, w, p, x, c in RULES if p is not None and w in s for m in p.finditer(s)]
    covers = lambda e, d: e[0] <= d[0] and e[1] >= d[1] and (e[2] < d[2] or e[2] == d[2] and e[1] - e[0] > d[1] - d[0])
    kept = [d for d in found if not any(covers(e, d) for e in found if abs(e[0] - d[0]) < 5000)]
    base = {x for p, x in ls.BASE.items() if f" {p} " in s}
    labels = ",".join(sorted(base | {d[3] for d in kept}))
    return len(words), labels, max((d[4] for d in kept), default=0.5 if base else 0.0), sorted(d[:4] for d in kept)


PARTS = [
    "Licensed under the Apache License, Version 2.0", "mit license", "GNU General\nPublic License version 3", "All rights\nreserved", "creative commons attribution 4.0",
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files", "GPLv2 or later", "see the BSD license",
    "Redistribution and use in source and binary forms", "released into the public\ndomain", "CC_BY-SA 4.0", "plain words", "x", "1 2", "é à", "under the terms of the mozilla public license 2.0",
    "GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version",
]


def rows(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return {r.doc_id: r for r in ls.scan_licenses(df).collect()}


def test_against_plain_reading(spark):
    rng = random.Random(4)
    texts = [" ".join(rng.choice(PARTS) for _ in range(rng.randrange(1, 9))) for _ in range(60)]
    texts += [" ".join(rng.choice(PARTS) for _ in range(900)), "mit license " * 6000, None, "", "a" * 1_000_000, "spam " * 50_000 + "apache license 2.0"]
    got = rows(spark, texts)
    for i, t in enumerate(texts):
        n, labels, score, kept = brute(t)
        r = got[i]
        assert (r.n_words, r.labels, r.score) == (n, labels, score), t and t[:80]
        assert sorted((d.start, d.end, d.k, d.x) for d in r.kept or []) == kept
