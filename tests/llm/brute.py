"""Plain versions of the operators, for small inputs."""

from __future__ import annotations

import bisect
import collections
import hashlib
import itertools
import math
import re
import struct
import zlib

import public_tokenizers
import sentencepiece
import tokenizers
import xxhash


def lower(text: str) -> str:
    return text.translate({c: c + 32 for c in range(65, 91)})


def words(text: str | None) -> list[str]:
    return re.findall(r"[^\x20\x09-\x0D]+", lower(text or ""))


def fingerprint(text: str | None) -> int:
    w = words(text)
    if not w:
        return 0
    shingles = [" ".join(w[i:i + 3]) for i in range(max(1, len(w) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(values: list[int], radius: int) -> list[int]:
    """For each position the smallest position that links reach."""
    root = list(range(len(values)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for i in range(len(values)):
        for j in range(i):
            if (values[i] ^ values[j]).bit_count() <= radius:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return [find(i) for i in range(len(values))]


def base_scores(rows: list[tuple[int | None, str | None]], fold: int, folds: int):
    """Per row: held out, tokens, known tokens, training tokens, unigram log probability."""
    held = [zlib.crc32(("" if i is None else str(i)).encode()) % folds == fold for i, _ in rows]
    tokens = [[*words(t), None] for _, t in rows]
    counts = collections.Counter(w for h, ws in zip(held, tokens) if not h for w in ws)
    n, v = sum(counts.values()), len(counts)
    return [(h, len(ws), sum(counts[w] > 0 for w in ws), n, sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in ws))
            for h, ws in zip(held, tokens)]


PERSONAL = [("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
            ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")]


def _luhn(digits: str) -> bool:
    doubled = [int(c) * (1 + i % 2) for i, c in enumerate(reversed(digits))]
    return sum(d - 9 * (d > 9) for d in doubled) % 10 == 0


def personal(text: str | None) -> list[tuple[str, int, int]]:
    out = []
    for kind, pattern in PERSONAL:
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            if (kind == "email" or kind == "ip" and all(int(p) <= 255 for p in m[0].split("."))
                    or kind == "card" and 16 <= len(digits) <= 19 and _luhn(digits)
                    or kind == "phone" and 8 <= len(digits) <= 15):
                out.append((kind, m.start(), m.end()))
    return out


def sha(text: str | bytes) -> str:
    return hashlib.sha256(text.encode() if isinstance(text, str) else text).hexdigest()


def ids_digest(ids: list[int]) -> str:
    return sha(struct.pack(f"<{len(ids)}I", *ids))


def aligned(texts: list[str | None]) -> list[tuple]:
    """Token counts, groups, links, links of the best count, sum of counts and digest of groups, link by link."""
    one, two = tokenizers.Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), sentencepiece.SentencePieceProcessor(
        model_file=public_tokenizers.path("piece_bpe_32k.model"))
    one.encode_special_tokens = True
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(sorted({*range(256)} - {*plain}))}
    rows, docs = [], collections.Counter()
    for text in texts:
        a, b = (one.encode(" " + text, add_special_tokens=False).ids, two.encode(text)) if text else ([], [])
        said_a = [bytes(letters[c] for c in one.id_to_token(i)) for i in a]
        said_b = [bytes([int(two.id_to_piece(i)[3:5], 16)]) if two.is_byte(i) else two.id_to_piece(i).replace("\u2581", " ").encode() for i in b]
        raw = (" " + (text or "")).encode()
        if not text or b"".join(said_a) != raw or b"".join(said_b) != raw:
            rows.append(None)
            continue
        ends_a, ends_b = (list(itertools.accumulate(map(len, s))) for s in (said_a, said_b))
        groups, low = [], 0
        for end in sorted(set(ends_a) & set(ends_b)):
            groups.append(tuple([i for i, e in zip(ids, ends) if low < e <= end] for ids, ends in ((a, ends_a), (b, ends_b)))
                          if len(raw) < 5_000 else _between(a, ends_a, b, ends_b, low, end))
            low = end
        links = collections.Counter()
        for ga, gb in groups:
            for x, n in collections.Counter(ga).items():
                for y, m in collections.Counter(gb).items():
                    links[x, y] += n * m
        docs.update(links.keys())
        rows.append((a, b, groups, links))
    most: dict[int, int] = {}
    for (x, _), n in docs.items():
        most[x] = max(most.get(x, 0), n)
    return [(0, 0, 0, 0, 0, 0, "") if r is None else
            (len(r[0]), len(r[1]), len(r[2]), r[3].total(), sum(n for p, n in r[3].items() if docs[p] == most[p[0]]),
             sum(docs[p] * n for p, n in r[3].items()),
             sha(";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in r[2])))
            for r in rows]


def _between(a, ends_a, b, ends_b, low, end):
    return tuple(ids[bisect.bisect_right(ends, low):bisect.bisect_right(ends, end)] for ids, ends in ((a, ends_a), (b, ends_b)))


def codes(rows: list[tuple], parts: int, entries: int, rounds: int) -> tuple[list[tuple], list[list[int]]]:
    """``id, label, code, error`` of the rows with usable vectors, and the codebook, in Python integers."""
    kept = [(i, lab, [math.floor(4096 * x) for x in v]) for i, v, lab in rows
            if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    fits = sorted(((i is None, i, v) for i, _, v in kept if v and len(v) % parts == 0), key=lambda r: (r[0], r[1] or 0, r[2]))
    dims = len(fits[0][2]) if fits else 0
    book = [v for _, _, v in fits if len(v) == dims][:entries]
    width = dims // parts

    def nearest(v: list[int], p: int) -> tuple[int, int]:
        return min((sum((x - c) ** 2 for x, c in zip(v[p * width:(p + 1) * width], e[p * width:(p + 1) * width])), k) for k, e in enumerate(book))

    for _ in range(rounds if book else 0):
        new = [list(e) for e in book]
        for p in range(parts):
            got = collections.defaultdict(list)
            for _, _, v in kept:
                if len(v) == dims:
                    got[nearest(v, p)[1]].append(v[p * width:(p + 1) * width])
            for k, vs in got.items():
                new[k][p * width:(p + 1) * width] = [sum(c) // len(vs) for c in zip(*vs)]
        book = new
    out = []
    for i, lab, v in kept:
        if len(v) != dims or not book:
            out.append((i, lab, None, None))
            continue
        near = [nearest(v, p) for p in range(parts)]
        error = sum(d for d, _ in near)
        out.append((i, lab, "".join(f"{k:02x}" for _, k in near), error if error < 1 << 63 else None))
    return out, book


def near_vectors(rows: list[tuple], threshold: float) -> list[tuple]:
    """``id, n_links, component_id, kept`` of rows ``id, vector, label``."""
    usable = [v is not None and lab is not None and len(v) > 0 and all(x is not None and math.isfinite(x) for x in v) and any(v) for _, v, lab in rows]
    root, links = list(range(len(rows))), [0] * len(rows)

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for a in range(len(rows)):
        for b in range(a):
            (_, v, one), (_, w, two) = rows[a], rows[b]
            if usable[a] and usable[b] and one == two and len(v) == len(w) and (
                    v == w or sum(x * y for x, y in zip(v, w)) / (math.hypot(*v) * math.hypot(*w)) >= threshold):
                links[a] += 1
                links[b] += 1
                x, y = sorted((find(a), find(b)))
                root[y] = x
    least: dict[int, int | None] = {}
    for a, (i, _, _) in enumerate(rows):
        r = find(a)
        known = [x for x in (least.get(r), i) if x is not None]
        least[r] = min(known) if known else None
    return [(i, links[a], least[find(a)], i == least[find(a)]) for a, (i, _, _) in enumerate(rows)]
