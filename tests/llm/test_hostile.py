"""Texts made to slow a reader down, or to slip past it."""

import base64
import json
import time

import pytest
import regex

from linkrisk.llm import bpe, html_text, licences, secrets


@pytest.mark.parametrize("pattern", ["<b '>'", "<b>x", "<a ", "<!--", "<p class='", "</x>", "<li><ul>", "<p><div>"])
def test_pages_take_linear_time(pattern):
    began = time.process_time()
    html_text.main_text(pattern * (1_000_000 // len(pattern)))
    assert time.process_time() - began < 8


@pytest.mark.parametrize("pattern", ["a:-----BEGIN PRIVATE KEY-----\n", "-----BEGIN PRIVATE KEY-----\na:b\n", "eyJx.", "eyJ", "-----BEGIN PRIVATE KEY-----\nMIIB", "token=", "30"])
def test_secrets_take_linear_time(pattern):
    began = time.process_time()
    secrets.confirmed_spans(pattern * (1_000_000 // len(pattern)))
    assert time.process_time() - began < 8


def part(value):
    return base64.urlsafe_b64encode(json.dumps(value).encode()).decode().rstrip("=")


def test_a_token_behind_one_that_is_none():
    token = f"{part({'alg': 'HS256'})}.{part({'sub': 'x'})}.abcdef"
    for before in ("", "eyJx.", "eyJx.eyJy.", "eyJx.eyJy.eyJz."):
        assert secrets.confirmed_spans(before + token) == [("signed_token", len(before), len(before) + len(token))]


def test_the_faster_word_pattern_equals_the_other_where_it_is_used():
    letters, numbers = (regex.compile(f"[{bpe.code_points(k, new)}]") for k, new in (("L", bpe.NEW_LETTERS), ("N", bpe.NEW_NUMBERS)))
    for c in map(chr, [*range(0xD800), *range(0xE000, 0x20000)]):
        if bpe.COMMON.fullmatch(c):
            assert bool(letters.match(c)) == bool(regex.match(r"\p{L}", c)) and bool(numbers.match(c)) == bool(regex.match(r"\p{N}", c)), hex(ord(c))
            assert bpe.lowered(c) == c.replace("Σ", "σ").lower()


def test_licences_by_sentences(spark):
    far = "whatever one may say about it and however long one goes on " * 8
    cases = {
        f"This is not, {far}licensed under the MIT license": "",
        "It is not only fast but also licensed under the MIT license.": "MIT",
        "Licensed under the MIT license or the Apache License, Version 2.0.": "Apache-2.0,MIT",
        "# SPDX-License-Identifier: Apache-2.0\nimport os": "Apache-2.0",
        "GNU GENERAL PUBLIC LICENSE\n   Version 3, 29 June 2007\n\nCopyright (C)": "GPL-3.0",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.": "ISC",
        "Neither the name of " + "the very long named company of many words and " * 4 + "others nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.": "",
        "Licensed under CC BY 3.0.": "CC-BY-3.0",
        "x " * 200_000 + ". Licensed under the MIT license.": "MIT",
    }
    df = spark.createDataFrame([(i, t, 1, "k") for i, t in enumerate(cases)], "doc_id long, text string, ids int, kind string")
    got = {r.doc_id: r for r in licences.scan(df).collect()}
    assert [got[i].licences for i in range(len(cases))] == list(cases.values())
    assert "bsd_neither bsd_nor" in got[6].sequence
