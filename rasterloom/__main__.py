"""``python -m rasterloom crop-border SRC DST`` and ``stack SRC... DST``."""

from __future__ import annotations

import argparse

import numpy as np

from .sources import images


def _read(path: str) -> np.ndarray:
    with open(path, "rb") as f:
        return images.decode(f.read())


def _write(path: str, a: np.ndarray) -> None:
    with open(path, "wb") as f:
        f.write(images.encode_png(a))


def crop_border(a: np.ndarray, fill: int = 255, thresh: int = 0) -> np.ndarray:
    odd = np.abs(a.astype(int) - fill).sum(axis=2) > thresh
    y, x = np.flatnonzero(odd.any(axis=1)), np.flatnonzero(odd.any(axis=0))
    return a[y[0]:y[-1] + 1, x[0]:x[-1] + 1] if len(y) else a


def stack(arrays: list[np.ndarray], axis: int = 0, pad: int = 0) -> np.ndarray:
    side = 1 - axis
    size, channels = max(a.shape[side] for a in arrays), max(a.shape[2] for a in arrays)
    parts = []
    for a in arrays:
        a = np.repeat(a, channels, axis=2) if a.shape[2] == 1 else a
        widths = [(0, 0)] * 3
        widths[side] = (0, size - a.shape[side])
        widths[axis] = (pad if parts else 0, 0)
        parts.append(np.pad(a, widths))
    return np.concatenate(parts, axis=axis)


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="rasterloom")
    sub = parser.add_subparsers(dest="command", required=True)
    crop = sub.add_parser("crop-border")
    crop.add_argument("src")
    crop.add_argument("dst", nargs="?")
    crop.add_argument("--fill", type=int, default=255)
    crop.add_argument("--thresh", type=int, default=0)
    join = sub.add_parser("stack")
    join.add_argument("paths", nargs="+")
    join.add_argument("--axis", type=int, default=0)
    join.add_argument("--pad", type=int, default=0)
    args = parser.parse_args(argv)
    if args.command == "crop-border":
        _write(args.dst or args.src, crop_border(_read(args.src), args.fill, args.thresh))
    else:
        *sources, target = args.paths
        _write(target, stack([_read(p) for p in sources], args.axis, args.pad))


if __name__ == "__main__":
    main()
