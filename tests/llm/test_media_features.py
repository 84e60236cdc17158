"""Features of stored images against plain Python, and files that the byte-level reader must refuse."""

from __future__ import annotations

import json
import math

import pytest

from tallyhall.llm import byte_bpe, media_source
from tallyhall.llm.tokens import default_path


@pytest.mark.parametrize("text", ["", "a", "plain words " * 30, "日本語 ünï" * 20, "\x00\x7f" * 100])
def test_feature_by_hand(text):
    p = media_source.pad(text.encode())
    mean = sum(p) / len(p)
    dev = math.sqrt(sum((x - mean) ** 2 for x in p) / len(p))
    cols = [sum(p[k::64]) / (len(p) // 64) for k in range(64)]
    bits = sum(1 << k for k, c in enumerate(cols) if c > mean + 1e-9)
    got = media_source.feature(p)
    head, _, tail = got.partition("m")
    m, _, rest = tail.partition("s")
    s, _, a = rest.partition("a")
    assert int(head[1:]) == len(p) // 64 and abs(float(m) - mean) < 1e-4 and abs(float(s) - dev) < 1e-4 and int(a, 16) == bits


def test_a_read_that_fails_is_repeated_from_a_new_file(tmp_path):
    class Fs:
        opened = 0

        def open_input_file(self, path):
            self.opened += 1
            return open(path, "rb")

    class Broken:
        def seek(self, at):
            raise OSError("gone")

    import zlib

    (tmp_path / "a").write_bytes(b"..payload")
    fs = Fs()
    assert media_source.MediaReader._payload(fs, str(tmp_path / "a"), 2, 7, zlib.crc32(b"payload"), Broken()) == b"payload" and fs.opened == 1
    with open(tmp_path / "a", "rb") as f:
        assert media_source.MediaReader._payload(fs, str(tmp_path / "a"), 2, 7, zlib.crc32(b"payload"), f) == b"payload" and fs.opened == 1


def test_other_tokenizer_files_are_refused(tmp_path):
    with open(default_path("byte_bpe_50k.json"), encoding="utf-8") as f:
        spec = json.load(f)
    for change in ({"normalizer": {"type": "NFC"}}, {"pre_tokenizer": {"type": "Whitespace"}}, {"pre_tokenizer": {**spec["pre_tokenizer"], "add_prefix_space": True}}):
        (tmp_path / "t.json").write_text(json.dumps({**spec, **change}))
        with pytest.raises(ValueError):
            byte_bpe.ByteBPE(str(tmp_path / "t.json"))
