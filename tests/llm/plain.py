"""Plain versions of the operators on tokens and phrases."""

import bisect
import hashlib
import math
import re
from collections import Counter, defaultdict

import cases
import public_tokenizers


def libraries():
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))


def spelled(text, a, b):
    """(id, bytes) of both sides, or two empty lists."""
    from vayuspark.llm.units import byte_letters

    back = {c: x for x, c in byte_letters().items()}
    if not text:
        return [], []
    one = [(i, bytes(back[c] for c in a.id_to_token(i))) for i in a.encode(" " + text, add_special_tokens=False).ids]
    two = [(i, bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode()) for i in b.encode(text) for p in [b.id_to_piece(i)]]
    whole = (" " + text).encode()
    return (one, two) if b"".join(x for _, x in one) == whole == b"".join(x for _, x in two) else ([], [])


def spans(tokens):
    at, out = 0, []
    for i, x in tokens:
        out.append((i, at, at + len(x)))
        at += len(x)
    return out


def alignments(texts):
    """For each text (n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256), and its links and groups."""
    a, b = libraries()
    done, count = [], Counter()
    for text in texts:
        one, two = (spans(x) for x in spelled(text, a, b))
        links, j = [], 0
        for i, (_, low, high) in enumerate(one):
            while two[j][2] <= low:
                j += 1
            k = j
            while k < len(two) and two[k][1] < high:
                links.append((i, k, min(high, two[k][2]) - max(low, two[k][1])))
                k += 1
        cuts = sorted({x[2] for x in one} & {x[2] for x in two})
        groups = [[bisect.bisect_left(cuts, x[2]) for x in side] for side in (one, two)]
        count.update((one[i][0], two[k][0]) for i, k, _ in links)
        done.append((one, two, links, groups, len(cuts)))
    most = {}
    for (_, y), n in count.items():
        most[y] = max(n, most.get(y, 0))
    out = []
    for one, two, links, groups, n in done:
        members = [[defaultdict(list) for _ in "ab"][k] for k in (0, 1)]
        for side, own, g in zip((one, two), members, groups, strict=True):
            for (i, _, _), at in zip(side, g, strict=True):
                own[at].append(str(i))
        text = ";".join(",".join(members[0][g]) + "|" + ",".join(members[1][g]) for g in range(n))
        pairs = [(one[i][0], two[k][0]) for i, k, _ in links]
        out.append((len(one), len(two), n, len(links), sum(count[p] == most[p[1]] for p in pairs), sum(count[p] for p in pairs), hashlib.sha256(text.encode()).hexdigest() if n else ""))
    return out, done


def phrases(rows, most_words, least, percent, limit):
    """Ranked phrases of (text, lang) rows."""
    f, n = defaultdict(Counter), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(cases.LOWER)):
            own = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(own)
            for k in range(1, most_words + 1):
                f[lang].update(tuple(own[i : i + k]) for i in range(len(own) - k + 1))
    out = []
    for lang, counts in f.items():
        good = {p: a for p, a in counts.items() if len(p) >= 2 and a >= least}
        gone = {p[i : i + k] for p, longer in good.items() for k in range(2, len(p)) for i in range(len(p) - k + 1) if 100 * longer >= percent * counts[p[i : i + k]]}
        ranked = []
        for p, a in good.items():
            if p not in gone:
                score, _, left, right = min((1000000 * a * a // (counts[p[:k]] * counts[p[k:]]), k, counts[p[:k]], counts[p[k:]]) for k in range(1, len(p)))
                ranked.append((-score, -a, " ".join(p).encode(), left, right))
        for i, (score, a, p, left, right) in enumerate(sorted(ranked)[:limit]):
            out.append((lang, i + 1, p.decode(), -a, left, right, n[lang], -score))
    return out


def lower_bound(lengths, capacity):
    """No packing has fewer sequences: the sum, and for each threshold what is too long to share (Martello and Toth)."""
    best = math.ceil(sum(lengths) / capacity)
    for low in sorted({x for x in lengths if 2 * x <= capacity} | {0}):
        big = [x for x in lengths if x > capacity - low]
        mid = [x for x in lengths if capacity - low >= x and 2 * x > capacity]
        small = [x for x in lengths if 2 * x <= capacity and x >= low]
        best = max(best, len(big) + len(mid) + max(0, math.ceil((sum(small) - (len(mid) * capacity - sum(mid))) / capacity)))
    return best
