"""Repair and prefix trie of conversations against versions without Spark; rendezvous shards."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from orderlens.llm import queries, repair, sharding, trie
from orderlens.llm.rows import description_rows
from orderlens.sources.orders import order_history

TURNS = "conv_id long, turn long, role string, text string, audit string, path int"


def least_by_rows(code):
    """Least (cost, audit) by trying every edit row after row."""
    states = {0: (0, "")}
    for i in range(len(code) + 1):
        for _ in range(3):
            for state, (cost, audit) in list(states.items()):
                to = repair.AFTER[state]
                states[to] = min(states.get(to, (10 ** 9, "")), (cost + 5, audit + "I"))
        if i == len(code):
            return min(states[s] for s in (0, 3) if s in states)
        row, after = code[i], {}
        for state, (cost, audit) in states.items():
            moves = [("D", state, 2)]
            if row != "d":
                more = 5 if row.isupper() else 0
                moves.append(("R", repair.AFTER[state], 1 + more))
                if row.lower() == "u" and state in (0, 1, 3) or row.lower() == "a" and state == 2:
                    moves.append(("K", repair.AFTER[state], more))
                if row.lower() == "s" and state == 0:
                    moves.append(("K", 1, more))
            for letter, to, price in moves:
                after[to] = min(after.get(to, (10 ** 9, "")), (cost + price, audit + letter))
        states = after


def test_least_edits():
    rng = random.Random(5)
    codes = ["", "ua", "sua", "au", "ss", "u", "a", "U", "xX", "d" * 30, "ua" * 300, "sU" * 40]
    codes += ["".join(rng.choice("suaxSUAXd") for _ in range(rng.randint(0, 12))) for _ in range(3000)]
    for code in codes:
        assert repair.least_edits(code) == least_by_rows(code), code


def test_audits_leave_the_pattern():
    rng = random.Random(6)
    for _ in range(300):
        code = "".join(rng.choice("suaxSUAXd") for _ in range(rng.randint(0, 20)))
        rows, state, out = iter(code), 0, ""
        for letter in repair.least_edits(code)[1]:
            row = next(rows) if letter != "I" else ""
            if letter == "D":
                continue
            role = row.lower() if letter == "K" else repair.WANTED[state][0]
            state = 1 if role == "s" else repair.AFTER[state]
            out += role
        assert next(rows, None) is None and re.fullmatch("(s?(ua)+)?", out)


def odd_turns(spark):
    rng = random.Random(7)
    data = [(1, t, r, x, "extra", 4) for t, r, x in [
        (0, "system", "Be brief."), (1, "user", "Hi?"), (1, "user", "Hi?"), (3, "assistant", "Yes"), (None, "tool", "ran."),
        (4, "user", " \t"), (5, None, None), (9, "assistant", "Done. \n")]]
    data += [(2, None, None, None, None, None), (3, 7, "", "", None, 1), (None, 1, "user", "lost.", None, 1)]
    data += [(4, t, "user" if t % 2 == 0 else "assistant", f"Line {t}.", None, None) for t in range(3000)]
    data += [(c, rng.choice([None, *range(5)]), rng.choice(["user", "assistant", "system", "bot", None]),
              rng.choice(["a.", "b", "", "é!", None, "long " * 50 + "."]), None, None)
             for c in range(10, 60) for _ in range(rng.randint(1, 9))]
    return spark.createDataFrame(data, TURNS), data


def repaired_plainly(rows):
    """Faults, audit and hash of one conversation's (turn, role, text)."""
    rows = [(t, " " if r is None else r, " " if x is None else x) for t, r, x in rows]
    rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2][:32], hashlib.md5(f"{len(r[1])}:{r[1]}{r[2]}".encode()).hexdigest()))
    seen, code, blank, duplicate, truncated = set(), "", 0, 0, 0
    for _, role, text in rows:
        letter, words = role[:1] if role[:1] in ("s", "u", "a") else "x", re.sub(r"[\x20\x09-\x0d]+$", "", text)
        if not words:
            blank, letter = blank + 1, "d"
        elif (role, text) in seen:
            duplicate, letter = duplicate + 1, "d"
        elif words[-1] not in ".!?":
            truncated, letter = truncated + 1, letter.upper()
        seen.add((role, text))
        code += letter
    turns = {t for t, _, _ in rows if t is not None}
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    cost, audit = least_by_rows(code)
    out, state, at = [], 0, iter(rows)
    for letter in audit:
        role, text = ("", "") if letter == "I" else next(at)[1:]
        if letter == "D":
            continue
        role = role if letter == "K" else repair.WANTED[state]
        out.append((role, text))
        state = 1 if role[0] == "s" else repair.AFTER[state]
    gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
    return (gaps, blank, duplicate, truncated, illegal, cost, audit), out


def test_repair_of_odd_conversations(spark):
    turns, data = odd_turns(spark)
    audits = repair.conversation_audits(turns).cache()
    got = {r[0]: tuple(r)[1:] for r in audits.collect()}
    fixed = repair.repaired_turns(turns, audits)
    digests = {r[0]: r[1] for r in repair.repaired_digests(fixed).collect()}
    texts = {}
    for r in sorted(fixed.collect(), key=lambda r: r["place"]):
        texts.setdefault(r["conv_id"], []).append((r["role"], r["text"]))
    assert set(got) == {d[0] for d in data}
    for conv_id in got:
        counts, out = repaired_plainly([d[1:4] for d in data if d[0] == conv_id])
        assert got[conv_id] == counts and texts.get(conv_id, []) == out, conv_id
        if out:
            assert digests[conv_id] == hashlib.sha256("\n".join(":".join(x) for x in out).encode()).hexdigest()
        else:
            assert conv_id not in digests
    assert repair.conversation_audits(turns.limit(0)).count() == 0
    assert repair.repaired_turns(turns.limit(0), audits.limit(0)).count() == 0


def test_repair_query_keeps_conversations_without_rows(spark, tmp_path):
    gone = next(t for t in range(1000) if zlib.crc32(f"5:{t}".encode()) % 20 == 0)
    kept = next(t for t in range(1000) if zlib.crc32(f"6:{t}".encode()) % 20 > 4)
    spark.createDataFrame([(5, gone, "user", "Hi."), (6, kept, "user", "Hi."), (None, None, "user", None)],
                          "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = {r["conv_id"]: r for r in queries.op11_repair(spark, str(tmp_path)).collect()}
    assert set(got) == {5, 6, None}
    assert got[5]["audit"] == "" and got[5]["repaired_sha256"] == hashlib.sha256().hexdigest() and got[5]["cost"] == 0
    assert (got[6]["cost"], got[6]["audit"]) == (2, "D")


def trie_plainly(paths):
    nodes = {}
    for conv_id, path in paths.items():
        for d in range(len(path) + 1):
            nodes.setdefault(path[:d], []).append(conv_id)
    out = {}
    for node, members in nodes.items():
        below = [n for n in nodes if n[:len(node)] == node]
        children = [n for n in below if len(n) == len(node) + 1]
        leaves = sum(not any(len(m) == len(n) + 1 and m[:len(n)] == n for m in nodes) for n in below)
        saved = sum((len(nodes[n]) - 1) * (n[-1][1] if n else 0) for n in below)
        ends = ",".join(str(c) for c in sorted(members) if paths[c] == node)
        out[min(members), len(node)] = (min(nodes[node[:-1]]) if node else None, len(members), len(children), leaves, saved,
                                        hashlib.sha256(ends.encode()).hexdigest())
    return out


def as_paths(spark, paths):
    rows = [(c, [(hashlib.md5(str(d).encode()).hexdigest(), n) for d, n in p], "x") for c, p in paths.items()]
    return spark.createDataFrame(rows, "conv_id long, path array<struct<digest: string, chars: long>>, node string")


def random_paths(seed, n, length, words):
    rng = random.Random(seed)
    hot = tuple((100 + i, i + 3) for i in range(12))
    paths = {c: tuple((w, w + 1) for w in (rng.randrange(words) for _ in range(rng.randint(0, length)))) for c in range(n)}
    paths.update({10_000 + c: hot for c in range(40)})
    paths.update({20_000 + c: hot[:rng.randint(0, 12)] + ((200 + c, 2),) for c in range(40)})
    paths.update({-5: ()})
    return paths


@pytest.mark.parametrize("seed,shard_nodes", [(1, 1), (2, 3), (3, 17), (4, 65536)])
def test_prefix_trie_of_any_shard_size(spark, seed, shard_nodes):
    paths = random_paths(seed, 150, 6, 3)
    got = {(r["conv_id"], r["depth"]): (r["parent_conv_id"], r["n_convs"], r["n_children"], r["n_leaves"], r["saved_tokens"], r["ends_sha256"])
           for r in trie.prefix_trie(as_paths(spark, paths), shard_nodes).collect()}
    want = trie_plainly(paths)
    assert len(got) == len(want)
    assert got == want


def test_prefix_trie_of_few_and_no_paths(spark):
    only = as_paths(spark, {7: ()})
    rows = trie.prefix_trie(only).collect()
    assert [(r["conv_id"], r["depth"], r["parent_conv_id"], r["n_convs"], r["n_children"], r["n_leaves"], r["saved_tokens"]) for r in rows] == [(7, 0, None, 1, 0, 1, 0)]
    assert trie.prefix_trie(only.limit(0)).count() == 0


def test_paths_take_turns_in_order(spark):
    turns, data = odd_turns(spark)
    paths = {r["conv_id"]: r["path"] for r in trie.conversation_paths(turns).collect()}
    assert set(paths) == {d[0] for d in data if d[0] is not None}
    assert [x["chars"] for x in paths[4]] == [len(f"Line {t}.") for t in range(3000)]
    assert [x["chars"] for x in paths[1]] == [4, 9, 3, 3, 3, 2, 0, 7]
    assert trie.conversation_paths(turns.limit(0)).count() == 0


def test_parentheses_close_where_a_stack_says():
    rng = np.random.default_rng(3)
    for size in (1, 2, 40, 3000):
        bits, depth = [True], 1
        while len(bits) < 2 * size:
            down = depth > 1 and rng.random() < 0.5 or depth >= 2 * size - len(bits)
            depth += -1 if down else 1
            bits.append(not down)
        want, stack = {}, []
        for i, b in enumerate(bits):
            if b:
                stack.append(i)
            else:
                want[stack.pop()] = i
        opens = np.flatnonzero(bits)
        assert trie.Parens(np.array(bits)).findclose(opens).tolist() == [want[i] for i in opens]


def test_shards_by_weight_and_growth(spark):
    rows = spark.range(20_000).selectExpr("id AS row_id", "repeat('é', id % 5) AS description", "'mine' AS shard")
    got = sharding.shard_places(rows, [1.0, 2.0, 1.0]).toPandas()
    counts = got.groupby("shard").size()
    assert len(got) == 20_000 and abs(counts[1] - 10_000) < 300 and abs(counts[0] - 5_000) < 300
    for _, part in got.groupby("shard"):
        assert sorted(part["slot"]) == list(range(len(part)))
    moved = got[got["shard"] != got["grown_shard"]]
    assert set(moved["grown_shard"]) == {3} and abs(len(moved) - 4_000) < 300
    grown = sharding.shard_places(rows, [1.0, 2.0, 1.0, 1.0]).toPandas().set_index("row_id")["shard"]
    assert (grown[got["row_id"]].to_numpy() == got["grown_shard"].to_numpy()).all()
    assert got.set_index("row_id")["size"][4] == 9 and got.set_index("row_id")["text_crc32"][4] == zlib.crc32("éééé".encode())


def test_shards_of_odd_rows(spark):
    rows = spark.createDataFrame([(None, None)] * 400 + [(None, "x")] * 300 + [(5, "same")] * 500 + [(i, "") for i in range(300)],
                                 "row_id long, description string").repartition(6)
    got = sharding.shard_places(rows, [1.0] * 8).toPandas()
    assert len(got) == 1500 and got[got["row_id"].isna()]["shard"].nunique() == 1
    for _, part in got.groupby("shard"):
        assert sorted(part["slot"]) == list(range(len(part)))
    assert sharding.shard_places(rows.limit(0), [1.0] * 8).count() == 0
    with pytest.raises(ValueError):
        sharding.with_shard(rows, [1.0, 0.0])


def test_shards_of_order_rows(spark, tmp_path):
    rows = order_history(spark, "/root/testdata/sf0.001").select("row_id", "description", "customer")
    sharding.write_shards(rows, f"{tmp_path}/shards", [1.0] * 4)
    back = spark.read.parquet(f"{tmp_path}/shards")
    places = sharding.shard_places(rows, [1.0] * 4)
    assert back.count() == 6000
    assert back.join(places.select("row_id", F.col("shard").alias("again")), "row_id").filter("shard <> again").count() == 0


def test_shard_rows_of_documents_are_native(spark):
    rows = description_rows(spark.createDataFrame([(1, "a")], "doc_id long, text string"))
    plan = sharding.shard_places(rows, [1.0] * 8)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
