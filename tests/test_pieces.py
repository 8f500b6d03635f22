"""Files read in pieces give the rows of files read whole."""

from __future__ import annotations

import random
from dataclasses import replace

import pytest

from termscan.functions.patterns import longest_match
from termscan.operators import pieces
from termscan.operators.matching import vocabulary
from termscan.plans import scan
from termscan.sources import trees, walk
from termscan.spec import ScanSpec

TERMS = ["a", "aa", "aaa", "aba", "abab", "b\n", "é", "éa", "𝄞", "﻿", "a" * 40, "ab" * 30, "never", "�", "x y"]
ENCODINGS = {"utf-8": b"", "utf-8-sig": b"", "utf-16-le": b"\xff\xfe", "utf-16-be": b"\xfe\xff", "utf-32-le": b"\xff\xfe\x00\x00", "utf-32-be": b"\x00\x00\xfe\xff"}


def spec_of(root, **more):
    given = {"anchor_terms": TERMS, "planned_hints_regex": "plan|todo", "code_hints_regex": "cl[ao]ss|de?f"}
    return ScanSpec(**{"include_paths": [str(root)], "extensions": ["txt"]} | given | more)


def rows_of(table):
    return sorted(map(tuple, table.collect()), key=str)


@pytest.fixture
def long_files(tmp_path):
    letters = random.Random(7)
    for encoding, mark in ENCODINGS.items():
        for weight in (0, 1, 40):  # no line ends, few, many
            alphabet = "a" * 60 + "b" * 30 + "é𝄞﻿x y" + "\n" * weight
            text = "".join(letters.choices(alphabet, k=6000)) + letters.choice(["", "plan", "class", "todo def"])
            (tmp_path / f"{encoding}-{weight}.txt").write_bytes(mark + text.encode(encoding))
    (tmp_path / "same.txt").write_text("a" * 9001)
    (tmp_path / "alternate.txt").write_text("ab" * 4501)
    (tmp_path / "lines.txt").write_text("\n" * 5000 + "  aba \t " * 400)
    broken = bytes(letters.choices([0x61, 0x62, 0x0A, 0x80, 0xBF, 0xC3, 0xA9, 0xE2, 0x82, 0xF0, 0x9F, 0xFF], k=9000))
    (tmp_path / "broken.txt").write_bytes(b"a" + broken)
    units = b"".join(letters.choices([b"a\x00", b"\x34\xd8", b"\x1e\xdd", b"\n\x00"], k=4000))
    (tmp_path / "surrogates.txt").write_bytes(b"\xff\xfe" + units + b"a")
    (tmp_path / "short.txt").write_text("aba")
    return tmp_path


def test_pieces_equal_whole_files(spark, long_files):
    whole = rows_of(scan.scan(spark, spec_of(long_files)).hits)
    for size in (1, 1300):  # the smallest that is possible, and another
        result = scan.scan(spark, spec_of(long_files, piece_bytes=size))
        assert rows_of(result.hits) == whole
        assert result.skipped.count() == 0
    assert {row[0] for row in whole} >= {"aa", "aba", "𝄞", "�"}


def test_pieces_put_together_are_the_text(spark, long_files):
    listing = trees.walk_tree(spark, [str(long_files)])
    whole = {r.path: r.text for r in trees.read_listed(listing).collect()}
    texts = {}
    for row in trees.read_pieces(listing, 1, 240).orderBy("path", "piece").collect():
        before = texts.setdefault(row.path, "")
        texts[row.path] = before + row.text
        assert whole[row.path].startswith(row.ahead, len(texts[row.path]))
        assert len(row.ahead) >= min(240, len(whole[row.path]) - len(texts[row.path]))
    assert texts == whole


def test_a_file_that_vanishes_between_its_pieces_has_a_reason_and_no_hits(spark, long_files, monkeypatch):
    real = walk._piece_reader

    def forgetful(piece_bytes, ahead_bytes, batch_bytes):
        read = real(piece_bytes, ahead_bytes, batch_bytes)

        def contents(batches):
            import os

            for batch in batches:
                for path, piece in zip(batch.column("name").to_pylist(), batch.column("piece").to_pylist()):
                    if path.endswith("same.txt") and piece == 3:
                        os.rename(path, path + ".gone")
                yield from read(iter([batch]))

        return contents

    monkeypatch.setattr(walk, "_piece_reader", forgetful)
    result = scan.scan(spark, spec_of(long_files, piece_bytes=1))
    names = {r.file.rsplit("/", 1)[1] for r in result.hits.collect()}
    assert "same.txt" not in names and "alternate.txt" in names
    assert [(r.path.rsplit("/", 1)[1], r.reason) for r in result.skipped.collect()] == [("same.txt", "FileNotFoundError")]


def test_patterns_that_need_whole_texts_get_them(spark, long_files):
    spec = spec_of(long_files, planned_hints_regex="^a.*b", piece_bytes=1)
    assert pieces.reach(vocabulary(TERMS), spec.planned_hints_regex) is None
    assert rows_of(scan.scan(spark, spec).hits) == rows_of(scan.scan(spark, replace(spec, piece_bytes=10**9)).hits)


def test_a_limit_on_length_is_kept(spark, long_files):
    result = scan.scan(spark, spec_of(long_files, piece_bytes=1, longest_text_bytes=9000))
    left = {r.path.rsplit("/", 1)[1] for r in result.skipped.collect()}
    assert left == {p.name for p in long_files.iterdir() if p.stat().st_size > 9000}
    assert not left & {r.file.rsplit("/", 1)[1] for r in result.hits.collect()}


@pytest.mark.parametrize("pattern, bound", [
    ("licen[cs]e|https?://", 20), ("[0-9]{3}-[0-9]{2,4}", 19 * 12), ("a+", None), ("a*", None), ("^a", None), ("a$", None),
    (r"\bword", None), (r"\d\.\w", 6), (r"(a)\1", None), ("(?=a)", None), ("(?s)a.b", None), ("(?:a|b)c", 8), ("a{2,}", None), (r"\+\*", 4),
    (r"\Aa", None), ("[^a]", None),
])
def test_bounds_of_patterns(pattern, bound):
    assert longest_match(pattern) == bound


def test_terms_that_overlap_themselves():
    assert [pieces.overlaps_itself(n) for n in ("a", "aa", "ab", "aba", "abcab", "abc")] == [False, True, False, True, True, False]
