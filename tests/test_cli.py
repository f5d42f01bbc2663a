import json

import numpy as np

from foliospark.cli import main
from foliospark.codecs import raster as R
from foliospark.operators.recognition import bounding_box, greedy_decode


def test_commands(tmp_path, capsys):
    img = np.full((20, 30, 3), 240, np.uint8)
    img[5:9, 5:15] = 0
    pages = tmp_path / "in"
    pages.mkdir()
    for n in "ab":
        (pages / f"{n}.png").write_bytes(R.write_png(img))
    book, one = str(tmp_path / "book.djvu"), str(tmp_path / "one.djvu")
    assert main(["encode", str(pages), "-o", book]) == 0 and main(["encode", str(pages / "a.png"), "-o", one, "--quality", "archival"]) == 0
    capsys.readouterr()
    assert main(["info", book, "--count"]) == 0 and capsys.readouterr().out.strip() == "2"
    assert main(["info", book, "--json"]) == 0 and json.loads(capsys.readouterr().out)[1]["width"] == 30
    assert main(["text", book, "--all"]) == 0 and capsys.readouterr().out.strip() == "No text layer\nNo text layer"
    for kind, magic in (("png", b"\x89PNG"), ("pdf", b"%PDF"), ("epub", b"PK"), ("tiff", b"II*"), ("cbz", b"PK")):
        out = tmp_path / f"x.{kind}"
        assert main(["render", one, "--format", kind, "-o", str(out)]) == 0 and out.read_bytes().startswith(magic)
    mask = tmp_path / "m.png"
    assert main(["render", book, "--layer", "mask", "-o", str(mask)]) == 0 and (R.read_png(mask.read_bytes())[:, :, 0] == 0).sum() == 40
    both, part = str(tmp_path / "both.djvu"), str(tmp_path / "part.djvu")
    assert main(["merge", book, one, "-o", both]) == 0 and main(["split", both, "--pages", "2-3", "-o", part]) == 0
    assert main(["info", part, "--count"]) == 0 and capsys.readouterr().out.strip() == "2"
    packed, plain = str(tmp_path / "z"), str(tmp_path / "p")
    assert main(["bzz-encode", book, "-o", packed]) == 0 and main(["bzz-decode", packed, "-o", plain]) == 0
    assert open(plain, "rb").read() == open(book, "rb").read()
    assert main(["info", str(mask)]) == 1 and main(["split", both, "--pages", "x", "-o", part]) == 1 and main(["render", one, "--layer", "foreground"]) == 1


def test_recognition_helpers():
    scores = np.eye(4)[[0, 1, 1, 0, 1, 2, 3, 3]]
    assert greedy_decode(scores, "abc") == "aabc"
    assert bounding_box([{"x": 1, "y": 2, "w": 3, "h": 4}, {"x": 0, "y": 5, "w": 9, "h": 9}]) == (0, 2, 9, 12) and bounding_box([]) == (0, 0, 0, 0)
