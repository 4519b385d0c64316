import re

from litscreen.llm.licenses import TEMPLATES, build_index, scan_licenses
from tests.llm.helpers import EDGES, documents

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def brute(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = WORD.findall(low)
    found = []
    for indexed in build_index(TEMPLATES):
        n = len(indexed.words)
        for start in range(len(words)):
            keys = all(words[start + at : start + at + len(key)] == key for at, key in indexed.keys)
            anchors = all(words[start + at : start + at + 1] == [word] for word, at in indexed.anchors)
            same = sum(a == b for a, b in zip(words[start : start + n], indexed.words)) / n
            if keys and anchors and same >= 0.8:
                found.append((indexed.template.label, start, n, same))
    return len(words), sorted(found)


def test_places_equal_brute_force(spark):
    mit = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software"
    texts = [
        "Released under the MIT License. mit  license MIT-LICENSE",
        "license mit license apache; apache license general public License",
        f"x {mit} and {mit.replace('any person', 'some people').upper()}",
        f"{mit.replace('hereby', 'here')}",
        "GNU General  Public\nLicense, lesser general public license",
        "redistribution and use in source and binary forms, with or without modification, are permitted",
        "CC BY-NC 4.0 and CC-BY-SA 4.0 and cc by 4.0, all rights reserved",
        "été-mit license; MİT license; éMIT license; \u212aMIT license mit",
        "mit license" * 3,
        " mit license " * 500,
        None,
        "",
    ]
    docs = documents(spark, list(enumerate(texts)) + EDGES)
    for row in scan_licenses(docs.withColumnRenamed("doc_id", "id"), id_col="text").collect():
        got = sorted((m.label, m.start, m.length, m.coverage) for m in row.matches)
        assert (row.n_words, got) == brute(row.text), row.text
    assert scan_licenses(docs.where("false")).count() == 0


def test_one_row_for_every_row(spark):
    assert scan_licenses(documents(spark, EDGES)).count() == len(EDGES)
