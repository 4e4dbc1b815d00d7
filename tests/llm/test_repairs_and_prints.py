"""Conversation repair, SimHash components and the Merkle manifest against brute force, with odd rows."""

import hashlib
import random
import zlib
from itertools import product

import numpy as np
import xxhash
from pyspark.sql import functions as F

from cubeloom.llm.conversation_repair import GOALS, GONE, MOVES, PUT, START, damage, lightest, repair_conversations
from cubeloom.llm.merkle_manifest import manifest_audit
from cubeloom.llm.simhash import enough_blocks, fingerprint, shard_links, simhash_components

KEY = dict(key=str)
BLANK = " \t\n\x0b\x0c\r"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# conversations


def every_repair(rows):
    """All audits with at most one insertion between rows, the cheapest first: (cost, audit, repaired rows)."""
    found = []
    for letters in product("DKR", repeat=len(rows)):
        for gaps in product(("", "I", "II"), repeat=len(rows) + 1):
            state, cost, said, ok = START, 0, [], True
            for k in range(len(rows) + 1):
                for _ in gaps[k]:
                    role, state = PUT[state]
                    said.append((role, ""))
                    cost += 5
                if k == len(rows) or not ok:
                    continue
                role, text, fault = rows[k]
                if letters[k] == "D":
                    cost += 2
                elif fault in ("blank", "duplicate"):
                    ok = False
                elif letters[k] == "K":
                    ok = role[:1] in MOVES[state]
                    state = MOVES[state].get(role[:1])
                    said.append((role, text))
                    cost += 5 * (fault == "truncated")
                else:
                    role, state = PUT[state]
                    said.append((role, text))
                    cost += 1 + 5 * (fault == "truncated")
                if not ok:
                    break
            if ok and state in GOALS:
                audit = "".join(g + x for g, x in zip(gaps, [*letters, ""]))
                found.append((cost, audit, said))
    return min(found, key=lambda x: x[:2])


def steps(rows):
    """The same by states, for longer conversations."""
    now = {START: (0, "", [])}

    def inserted(now):
        for _ in range(4):
            for q, (c, a, said) in list(now.items()):
                role, to = PUT[q]
                new = (c + 5, a + "I", [*said, (role, "")])
                if to not in now or new[:2] < now[to][:2]:
                    now[to] = new
        return now

    for role, text, fault in rows:
        after = {}
        for q, (c, a, said) in inserted(now).items():
            options = [(q, c + 2, a + "D", said)]
            if fault not in ("blank", "duplicate"):
                more = 5 * (fault == "truncated")
                if role[:1] in MOVES[q]:
                    options.append((MOVES[q][role[:1]], c + more, a + "K", [*said, (role, text)]))
                options.append((PUT[q][1], c + 1 + more, a + "R", [*said, (PUT[q][0], text)]))
            for to, *new in options:
                if to not in after or tuple(new[:2]) < after[to][:2]:
                    after[to] = tuple(new)
        now = after
    now = inserted(now)
    return min((now[q] for q in GOALS if q in now), key=lambda x: x[:2])


def brute_repairs(table, repair=steps):
    convs = {}
    for conv, turn, role, text in table:
        rows = convs.setdefault(conv, [])
        one = lambda v: " " if v is None else v
        fate = zlib.crc32(f"{one(conv)}:{one(turn)}".encode()) % 20
        role, text = one(role), one(text)
        if fate == 0:
            continue
        if fate == 1:
            text = ""
        if fate == 2:
            text = text.translate({ord(c): None for c in ".!?"})
        rows += [(turn, "user" if fate == 4 else role, text)] * (2 if fate == 3 else 1)
    out = set()
    for conv, rows in convs.items():
        rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        seen, marked, counts = set(), [], dict(blank=0, duplicate=0, truncated=0)
        for _, role, text in rows:
            end = text.rstrip(BLANK)
            fault = "blank" if not end else "duplicate" if (role, text) in seen else "truncated" if end[-1] not in ".!?" else None
            seen.add((role, text))
            marked.append((role, text, fault))
            if fault:
                counts[fault] += 1
        turns = [t for t, *_ in rows if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(marked, marked[1:]))
        cost, audit, said = repair(marked)
        out.add((conv, gaps, *counts.values(), illegal, cost, audit, sha("\n".join(f"{r}:{t}" for r, t in said))))
    return out


def conversations(rng, n, longest):
    texts = ["A b.", "cut off", "x?", "", " \t", None, "é ☃!", "y.\n", "So", "A b. ", "z. . z"]
    roles = ["system", "user", "assistant", "assistant", "user", "tool", None, "", "Sys"]
    rows = []
    for conv in [*range(n), None]:
        for turn in range(rng.randrange(1, longest)):
            role = rng.choice(roles) if rng.random() < 0.3 else ("user", "assistant")[turn % 2]
            text = rng.choice(texts) if rng.random() < 0.5 else f"{turn} words{rng.choice('.!,')}"
            rows.append((conv, None if rng.random() < 0.05 else turn + (turn > 3), role, text))
    return rows + rows[::7]


def test_repairs_of_short_conversations():
    rng = random.Random(4)
    for _ in range(60):
        rows = [(rng.choice(["system", "user", "assistant", "tool"]), f"t{k}", rng.choice([None, None, "truncated", "blank"])) for k in range(rng.randrange(4))]
        want = every_repair(rows)[:2]
        assert steps(rows)[:2] == want
        kinds = {None: 1, "truncated": 2, "blank": 0}
        assert list(lightest([(r[:1], kinds[f], 1) for r, _, f in rows], {START: (0, "")}, GOALS).values()) == [want]


def test_repaired_conversations(spark):
    rows = conversations(random.Random(5), 60, 9) + [(1000, k, "user" if k % 3 else "assistant", f"text {k % 40}.") for k in range(700)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("cost", F.lit("x")).withColumn("times_", F.lit(1))
    want = brute_repairs(rows)
    names = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    for parts, dealt in ((None, df), (1, df.coalesce(1)), (7, df.repartition(9)), (61, df.repartition(2))):
        found = repair_conversations(damage(dealt), parts)
        assert found.columns == names
        found = found.collect()
        assert len(found) == len(want) and {tuple(r) for r in found} == want
    assert repair_conversations(damage(df.limit(0))).count() == 0


def test_turns_without_numbers_and_long_texts(spark, monkeypatch):
    rows = [(1, None, "user", "a" * 3_000_000 + "."), (1, None, "assistant", "b."), (2, None, "tool", "only."), (3, 5, None, None)] + [(4, 7, "user", "same.")] * 500
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    assert {tuple(r) for r in repair_conversations(damage(df)).collect()} == brute_repairs(rows)
    assert lightest([("t", GONE, 3)], {START: (0, "")}, GOALS) == {START: (6, "DDD")}


# fingerprints


def brute_fingerprint(text):
    words = [w for w in "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").translate({ord(c): " " for c in BLANK}).split(" ") if w]
    shingles = [" ".join(words[k : k + 3]) for k in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0


def brute_components(fps, radius=3):
    """The lowest id reachable, by a flood over all fingerprints."""
    ids = {}
    for k, f in fps:
        ids.setdefault(f, []).append(k)
    left, out = set(ids), {}
    while left:
        todo, group = [left.pop()], []
        while todo:
            f = todo.pop()
            group.append(f)
            near = {g for g in left if (f ^ g).bit_count() <= radius}
            left -= near
            todo += near
        low = min((k for f in group for k in ids[f] if k is not None), default=None)
        out |= dict.fromkeys(group, low)
    return {(k, f"{f:016x}", out[f]) for k, f in fps}


def texts_near(rng):
    words = ["".join(rng.choice("abcdefgéß") for _ in range(rng.randrange(1, 7))) for _ in range(200)]
    texts = [None, "", " \n\t", "One", "one two", "one two three", "ONE two\x0bthree", "x " * 400, "\x1cword\x85 here now"]
    for _ in range(60):
        base = [rng.choice(words) for _ in range(rng.randrange(50, 400))]
        texts.append(" ".join(base))
        for _ in range(rng.randrange(4)):
            base[rng.randrange(len(base))] = "changed"
            texts.append(" ".join(base).upper() if rng.random() < 0.2 else " ".join(base))
    return texts


def test_simhash_components(spark):
    rows = [(k, t, "x", "y") for k, t in enumerate(texts_near(random.Random(8)))]
    rows += [(3, "nothing alike in here", "x", "y"), rows[20], (None, rows[21][1], "x", "y"), (None, "all by itself", "x", "y")]
    df = spark.createDataFrame(rows, "doc_id long, text string, fp string, component_id string").repartition(5)
    want = brute_components([(r[0], brute_fingerprint(r[1])) for r in rows])
    for options in ({}, {"tree_size": 3}, {"blocks": 5}, {"blocks": 6, "tree_size": 2}):
        found = simhash_components(df, **options)
        assert found.columns == ["doc_id", "fingerprint", "component_id"] and found.count() == len(rows)
        assert {tuple(r) for r in found.collect()} == want
    assert simhash_components(df.limit(0)).count() == 0


def test_long_texts_are_read_in_parts(monkeypatch):
    import cubeloom.llm.simhash as s

    monkeypatch.setattr(s, "_PART", 50)
    for text in texts_near(random.Random(9)):
        assert fingerprint((text or "").encode()) == brute_fingerprint(text)


def test_bk_trees_find_all_links():
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 63, 40, dtype=np.uint64)
    fps = np.unique(np.concatenate([base, *[base ^ (np.uint64(1) << rng.integers(0, 24, 40, dtype=np.uint64)) ^ (np.uint64(1) << rng.integers(0, 24, 40, dtype=np.uint64)) for _ in range(40)]]))
    rng.shuffle(fps)
    group = np.sort(rng.integers(0, 3, len(fps)))
    for asks in (np.zeros(len(fps), bool), rng.random(len(fps)) < 0.5):
        a, b = shard_links(fps, group, asks)
        assert len(a) < len(fps) and all(int(x ^ y).bit_count() <= 3 for x, y in zip(a, b))
        for g in range(3):
            mine = set(fps[group == g].tolist())
            links = {f: set() for f in mine}
            for x, y in zip(a.tolist(), b.tolist()):
                if x in mine:
                    links[x].add(y)
                    links[y].add(x)
            asked = dict(zip(fps.tolist(), asks.tolist()))
            reach, want = [], []
            for near, out in ((lambda f, links=links: links[f], reach), (lambda f, mine=mine: {h for h in mine if (f ^ h).bit_count() <= 3 and (not asks.any() or asked[f] != asked[h])}, want)):
                left = set(mine)
                while left:
                    todo, part = [left.pop()], set()
                    while todo:
                        f = todo.pop()
                        part.add(f)
                        new = near(f) & left
                        left -= new
                        todo += new
                    out.append(frozenset(part))
            assert set(reach) == set(want)
    assert enough_blocks(10**6) == 4 and enough_blocks(10**9) == 5 and enough_blocks(10**13) > 5


# manifest


def brute_manifest(rows):
    field = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = lambda d, s, la, n, t: sha("".join(map(field, (d, s, la, n, t))))
    groups = {}
    for r in rows:
        groups.setdefault(r[1], []).append((r[0] is not None, r[0] or 0, leaf(*r), r))

    def levels(nodes):
        out = [nodes]
        while len(out[-1]) > 1:
            out.append([sha("".join(out[-1][k : k + 3])) for k in range(0, len(out[-1]), 3)])
        return out

    def path(tree, k):
        for level in tree[:-1]:
            at = k - k % 3
            yield level[at:k], level[k + 1 : at + 3]
            k //= 3

    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: levels([x[2] for x in sorted(groups[s], key=lambda x: x[:3])]) for s in names}
    top = levels([trees[s][-1][0] for s in names])
    out = []
    for s in names:
        for k, (_, _, own, (d, _, la, n, t)) in enumerate(sorted(groups[s], key=lambda x: x[:3])):
            way = [*path(trees[s], k), *path(top, names.index(s))]
            even = d is not None and zlib.crc32(str(d).encode()) % 2 == 0
            met = leaf(d, s, la, n, t.replace("\n", "") if even and t is not None else t)
            for before, after in way:
                met = sha("".join(before) + met + "".join(after))
            root = top[-1][0]
            out.append((d, own, trees[s][-1][0], root, sha("".join("".join(b + a) for b, a in way)), met, met == root))
    return sorted(out, key=str)


def test_merkle_manifest(spark):
    rng = random.Random(2)
    sources = ["hot"] * 9 + [None, "", "a", "é", "Z", "only"]
    rows = [(k * 3 % 101 if k % 50 else None, rng.choice(sources), rng.choice(["en", None, ""]), rng.choice([None, k]), rng.choice(["a\nb\n", "c", None, "", "é\n☃" * k])) for k in range(150)]
    rows += [rows[5], rows[5], (7, "hot", "en", 1, "w\n" * 200_000)]
    df = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string").withColumn("leaf", F.lit(1)).withColumn("grp", F.lit(1)).withColumn("path", F.lit(1))
    for part in (df.repartition(1), df.repartition(13)):
        found = manifest_audit(part)
        assert found.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
        assert sorted((tuple(r) for r in found.collect()), **KEY) == brute_manifest(rows)
    for few in ([rows[1]], rows[:2], [r for r in rows if r[1] == "hot"][:28]):
        assert sorted((tuple(r) for r in manifest_audit(spark.createDataFrame(few, df.schema.names[:5] and "doc_id long, source string, lang string, n_chars long, text string")).collect()), **KEY) == brute_manifest(few)
    assert manifest_audit(df.limit(0)).count() == 0
