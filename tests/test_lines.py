import random

import pytest

from sumforge.sources import lines


@pytest.mark.parametrize("piece", [7, 100, lines.PIECE])
def test_any_lines_of_any_files(spark, tmp_path, piece):
    rng = random.Random(piece)
    texts = {"a.txt": "".join(rng.choice(["x", "é漢", "\n", "tab\t", "\r\n"]) for _ in range(400)), "b.txt": "one\ntwo", "c.txt": "\n\n", "d.txt": "", "e.txt": "z" * 300 + "\nlast\n"}
    for name, text in texts.items():
        (tmp_path / name).write_bytes(text.encode())
    pieces = lines.index(spark, str(tmp_path), piece=piece)
    for first, last in ((0, 10**9), (0, 1), (3, 40), (57, 60), (500, 600)):
        want = set()
        for name, text in texts.items():
            each = text.split("\n")
            each = each[:-1] if each[-1] == "" else each
            want |= {(name, k, v.removesuffix("\r")) for k, v in enumerate(each) if first <= k < last}
        assert {(r.file.rsplit("/", 1)[1], r.line, r.value) for r in lines.read(pieces, first, last).collect()} == want


def test_only_the_pieces_in_question_are_opened(spark, tmp_path):
    (tmp_path / "big.txt").write_text("".join(f"{k}\n" for k in range(50_000)))
    pieces = lines.index(spark, str(tmp_path), piece=1000).cache()
    assert pieces.count() > 200 and [r.value for r in lines.read(pieces, 31_000, 31_003).orderBy("line").collect()] == ["31000", "31001", "31002"]
    assert pieces.where("first < 31003 AND last > 31000").count() <= 2
