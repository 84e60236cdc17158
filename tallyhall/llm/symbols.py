"""The characters that stand for bytes in byte-level vocabularies."""

from __future__ import annotations


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in a vocabulary file."""
    shown = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    names, spare = {b: chr(b) for b in shown}, 256
    for b in range(256):
        if b not in names:
            names[b], spare = chr(spare), spare + 1
    return [names[b] for b in range(256)]
