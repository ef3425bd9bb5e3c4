"""Secret scans, conversation repair and the filter audit against plain versions."""

import hashlib
import itertools
import random
import re
import string
import zlib

import duckdb
import numpy as np
import pandas as pd
import pytest

from lexiscape.llm import filters, queries, repair, secrets
from lexiscape.llm import text as T

DOCS = "doc_id long, text string, source string, part string, mask int, TEXT2 string"


def frame(spark, rows, schema="doc_id long, text string, source string"):
    return spark.createDataFrame(rows, schema)


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


# ---- filters ----


def plain_audit(docs, labels):
    rows = []
    for d, t, s in docs:
        t = t or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = {
            "A": len(words) < 50,
            "B": 100 * len(set(words)) < 65 * len(words),
            "C": 100 * len(re.findall("[A-Z]", t)) > 5 * len(t),
            "D": bool(re.search(r"[#$%&*|]", t)),
            "E": d is not None and any(o is not None and o < d and (u or "") == t for o, u, _ in docs),
        }
        good = any(x == d and d is not None and q == 1 for x, q, _ in labels)
        toxic = any(x == d and d is not None and y == 1 for x, _, y in labels)
        rows.append((s or "", {k for k, v in fails.items() if v}, good, toxic))
    out = []
    orders = ["".join(o) for o in itertools.permutations("ABCDE")]
    for part in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == part]
        first = {f: sum(next((x for x in o if x in r[1]), "") == f for o in orders for r in own) for f in "ABCDE"}
        for o in orders:
            for step, f in enumerate(o, 1):
                here = [r for r in own if f in r[1] and not r[1] & set(o[: step - 1])]
                out.append((part, o, step, sum(not r[1] & set(o[:step]) for r in own), len(here), sum(f in r[1] for r in own) - len(here), sum(r[1] == {f} for r in own), sum(r[2] for r in here), sum(r[3] for r in here), first[f]))
    return sorted(out, key=repr)


def odd_documents():
    rng = random.Random(3)
    words = ["alpha", "Beta", "GAMMA", "δέλτα", "x" * 300, "e#", "|", "tab\x0bbed", "nb sp"]
    docs = []
    for i in range(120):
        n = rng.choice([0, 1, 20, 49, 50, 51, 80])
        docs.append((i, rng.choice([" ", "\n", "  "]).join(rng.choice(words) if rng.random() < 0.3 else f"w{rng.randrange(60)}" for _ in range(n)), rng.choice(["a", "a", "b", None, ""])))
    docs += [(200 + i, docs[5][1], "a") for i in range(40)] + [(5, docs[5][1], "b"), (300, None, None), (301, "", "a"), (None, "", "a"), (None, docs[5][1], "b"), (302, "ß " * 60, "c")]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1])) for i in range(0, 120, 2)] + [(5, 1, 0), (5, 0, 1), (None, 1, 1), (999, 1, 1)]
    return docs, labels


def test_audit_is_the_plain_one(spark):
    docs, labels = odd_documents()
    got = filters.audit(frame(spark, docs), frame(spark, labels, "doc_id long, quality int, toxic int"))
    assert rows_of(got) == plain_audit(docs, labels)


def test_audit_clashing_columns_and_empty_tables(spark):
    docs, labels = odd_documents()
    d = spark.createDataFrame([(*r, "q", 7, "z") for r in docs], DOCS)
    few = spark.createDataFrame([(*r, "q", 3) for r in labels], "doc_id long, quality int, toxic int, part string, n int")
    assert rows_of(filters.audit(d, few)) == plain_audit(docs, labels)
    assert filters.audit(d.limit(0), few).count() == 0
    assert rows_of(filters.audit(d, few.limit(0))) == plain_audit(docs, [])


def test_hashes_that_clash_are_counted_by_words():
    texts = ["a b a c", "aa bb aa", "", "x y", "long words of any kind of words"]
    import pyarrow as pa

    raw, offsets = T.flat(pa.array(texts))
    starts, ends, owner = T.runs(raw != 0x20, offsets)
    for hashes in (T.run_hashes, lambda raw, s, e: np.zeros(len(s), np.uint64), lambda raw, s, e: raw[s].astype(np.uint64)):
        assert filters.different_words(raw, starts, ends, owner, len(texts), hashes).tolist() == [len(set(t.split())) for t in texts]


def test_pieces_change_nothing(monkeypatch):
    import pyarrow as pa

    docs, _ = odd_documents()
    column = pa.array([t for _, t, _ in docs])
    whole = filters.measured(column)
    monkeypatch.setattr(filters, "PIECE", 7)
    assert all((whole[k] == v).all() for k, v in filters.measured(column).items())


# ---- conversations ----


def plain_rows(conv, rows):
    out = []
    for turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        d = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if d == 1 else re.sub("[.!?]", "", text) if d == 2 else text
        out += [(turn, "user" if d == 4 else role, text)] * (0 if d == 0 else 2 if d == 3 else 1)
    return sorted(out, key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(r[2].encode()).hexdigest()))


def plain_faults(rows):
    seen, out = set(), []
    for _, role, text in rows:
        body = re.sub(r"[\x20\x09-\x0D]", "", text)
        out.append("blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def cheapest(rows, faults):
    """All audits by a heap of (cost, audit), with the repaired lines."""
    import heapq

    heap, done = [(0, "", 0, "", ())], {}
    while heap:
        cost, audit, i, roles, lines = heapq.heappop(heap)
        if i == len(rows) and re.fullmatch("(s?(ua)+)?", roles):
            return cost, audit, lines
        if (i, roles[-1:], len(roles) > 0) in done:
            continue
        done[i, roles[-1:], len(roles) > 0] = 1
        ways = [] if roles.endswith("u") else [("I", "u", 5, i, "user:")]
        ways += [("I", "a", 5, i, "assistant:")] if roles.endswith("u") else []
        if i < len(rows):
            _, role, text = rows[i]
            ways.append(("D", "", 2, i + 1, None))
            if faults[i] not in ("blank", "duplicate"):
                more = 5 * (faults[i] == "truncated")
                ways.append(("K", role[:1] or "x", more, i + 1, f"{role}:{text}"))
                ways += [("R", r[0], 1 + more, i + 1, f"{r}:{text}") for r in ("user", "assistant")]
        for x, r, c, j, line in ways:
            if not r or re.fullmatch("s?(ua)*u?", roles + r):
                heapq.heappush(heap, (cost + c, audit + x, j, roles + r, lines if line is None else (*lines, line)))


def plain_repair(rows):
    out = []
    for conv in {r[0] for r in rows}:
        own = plain_rows(conv, [r[1:] for r in rows if r[0] == conv])
        faults, turns = plain_faults(own), [t for t, _, _ in own if t is not None]
        illegal = sum((a[1][:1] + b[1][:1]) not in ("su", "ua", "au") for a, b in zip(own, own[1:]))
        cost, audit, lines = cheapest(own, faults)
        out.append((conv, max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *(faults.count(k) for k in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return sorted(out, key=repr)


CONV = "conv_id long, turn long, role string, text string"


def odd_conversations():
    rng = random.Random(5)
    texts = ["Hello.", "Well?", "no end", "", "  ", " ", "Same.", "a!\x0b", None, "x" * 5000 + ".", "one\ntwo."]
    rows = [(c, rng.choice([t, t, t, t + 3, None]) if c % 3 else t, rng.choice(["system", "user", "assistant", "user", "assistant", "tool", "", None]), rng.choice(texts)) for c in range(150) for t in range(rng.randrange(1, 9))]
    return rows + [(None, t, "user", "Hi.") for t in range(4)] + [(900, 1, "user", "Twice.")] * 3


def test_repair_is_the_plain_one(spark):
    rows = odd_conversations()
    got = repair.repaired(frame(spark, rows, CONV))
    assert rows_of(got) == plain_repair(rows)


def test_repair_clashing_columns_and_empty_table(spark):
    rows = odd_conversations()[:60]
    df = spark.createDataFrame([(*r, "x", 5, 1) for r in rows], CONV + ", audit string, cost int, pos int")
    assert rows_of(repair.repaired(df)) == plain_repair(rows)
    assert repair.repaired(df.limit(0)).count() == 0


def test_long_conversation_in_many_parts(spark, monkeypatch):
    monkeypatch.setattr(repair, "CHUNK", 3)
    rng = random.Random(8)
    rows = [(1, t, "user" if t % 2 == 0 else "assistant", rng.choice(["Yes.", f"No {t}.", f"open {t}"])) for t in range(700)] + [(2, 0, "user", "Hi."), (2, 1, "assistant", "Ho.")]
    assert rows_of(repair.repaired(frame(spark, rows, CONV).repartition(7))) == plain_repair(rows)


def test_trie_shares_and_answers_alone(spark):
    rng = random.Random(2)
    sigs = sorted("".join(rng.choice(repair.SYMBOLS) for _ in range(rng.randrange(7))) for _ in range(800))
    together = list(repair.solved(sigs))
    assert together == [next(repair.solved([s])) for s in sigs]
    for s, answer in zip(sigs, together):
        rows = [(i, ["s", "u", "a", "x"][repair.SYMBOLS.index(c) // 4], "") for i, c in enumerate(s)]
        faults = [["", "blank", "duplicate", "truncated"][repair.SYMBOLS.index(c) % 4] for c in s]
        assert cheapest(rows, faults)[:2] == answer


# ---- secrets ----


def plain_spans(text):
    out = []
    for kind, pattern in (("assign", r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""), ("access", "AKIA[A-Z0-9]+"), ("hex", "[0-9a-f]+")):
        for m in re.finditer(pattern, text):
            if len(m[2]) >= 6 if kind == "assign" else len(m[0]) >= (20 if kind == "access" else 24):
                out.append((m.start(), m.end(), kind))
    return sorted(out, key=lambda x: (x[0], secrets.KINDS.index(x[2])))


def test_base_spans_are_plain_matches():
    rng = random.Random(4)
    bits = ["password", "PassWd", "SECRET", "token", "toKen", "ſecret", "api_key", "APIKEY", "apikey", "=", ":", " ", '"', "'", "AKIA", "ABCDEFGH12345678", "0123456789abcdef", "deadbeef", "g", "x.y=z", "ß", "\n", "İ", "short"]
    for _ in range(20_000):
        t = "".join(rng.choice(bits) for _ in range(rng.randrange(14)))
        assert secrets.base(t) == plain_spans(t), t


@pytest.fixture(scope="module")
def model():
    return secrets.Novelty(secrets.dictionary([]))


def test_random_keys_are_found_and_names_left(model):
    rng = random.Random(6)
    alphabets = [string.ascii_letters + string.digits, string.ascii_letters + string.digits + "+/", string.ascii_lowercase + string.digits, string.ascii_uppercase + string.digits]
    found = 0
    for i in range(400):
        key = "".join(rng.choice(alphabets[i % 4]) for _ in range(rng.choice([20, 24, 32, 40])))
        t = f"Use the client credential {key} when the session starts."
        found += any((s, e) == (t.index(key), t.index(key) + len(key)) for s, e, _ in secrets.novel(t, secrets.base(t), model))
        assert not secrets.novel(f"The library has a record {key} for you.", [], model)  # no sensitive word
    assert found >= 360
    for name in ("getUserTokenFromSession", "session_token_timeout_seconds", "example.com/docs/session-cookie-policy", "your-api-key-goes-here-1234", "xxxxxxxxxxxxxxxxxxxx", "com.example.project.SecretManager", "token_type_ids", "passwordResetRequestHandler"):
        assert not secrets.novel(f"auth: see {name} for the token.", [], model), name


def test_novelty_is_the_marginal_size(model):
    import zstandard

    z = zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(secrets.dictionary([])), level=secrets.LEVEL, write_content_size=False, write_dict_id=False)
    around, own = "the bearer is  and goes on", "qT7xPz0LmV2kRw9sYb4N"
    assert model.of(around, own) == (len(z.compress(f"{around}\n{own}".encode())) - len(z.compress(around.encode()))) / len(own)


def test_names_of_code_are_mostly_left(model):
    """Names in the standard library's sources, as if each stood beside a sensitive word."""
    import os

    root, names = os.path.dirname(os.__file__), set()
    for f in sorted(os.listdir(root)):
        if f.endswith(".py"):
            names |= {x.strip(".=-_") for x in re.findall(r"[A-Za-z0-9+/_.=-]{16,}", open(f"{root}/{f}", errors="ignore").read())}
    names = [x for x in names if len(x) >= 16 and not re.fullmatch(r"[0-9._e+/-]+|[0-9a-fx-]+", x)]
    hit = sum(bool(secrets.novel(f"auth: see {x} for the token.", [], model)) for x in names)
    assert len(names) > 3000 and hit < 0.05 * len(names)


def test_scan_of_odd_rows(spark):
    key = "qT7xPz0LmV2kRw9sYb4NcD"
    docs = [(1, f"Authorization: Bearer {key}\n"), (1, f"Authorization: Bearer {key}\n"), (None, "password=hunter22"), (3, None), (4, ""), (5, "x " * 300_000 + f"secret key {key}"), (6, f'token = "{key}"'), (7, "AKIA" + "A" * 16 + " " + "0" * 24), (8, f"İ the credential is {key}")]
    df = spark.createDataFrame([(*d, "x", 3) for d in docs], "doc_id long, text string, spans string, n_hex int")
    got = sorted((tuple(r) for r in secrets.detect(df).collect()), key=repr)
    want = []
    trained = secrets.Novelty(secrets.dictionary([]), secrets.dictionary(secrets.pieces(df)))
    for d, t in docs:
        plain = plain_spans(t or "")
        every = sorted(plain + secrets.novel(t or "", plain, trained), key=lambda x: (x[0], secrets.KINDS.index(x[2])))
        want.append((d, *(sum(k == x for *_, x in plain) for k in secrets.KINDS[:3]), hashlib.sha256(secrets.joined(plain).encode()).hexdigest(), secrets.joined(every)))
    assert got == sorted(want, key=repr)
    spans = {r[0]: r[5] for r in got}
    assert spans[1] == "novel:22:44" and spans[5] == "novel:600011:600033" and spans[6].startswith("assign:") and "novel" not in spans[6] and spans[8] == "novel:20:42"
    assert spans[3] == spans[4] == "" and spans[7] == f"access:0:20,hex:21:45"
    assert secrets.detect(df.limit(0)).count() == 0


def test_pieces_are_counted_over_all_documents(spark):
    docs = [(i, "alpha Beta gammaRay DELTA x1yz12 " + ("omega " if i % 2 else "")) for i in range(50)]
    assert secrets.pieces(spark.createDataFrame(docs, "doc_id long, text string"), 3) == ["Beta", "DELTA", "alpha"]
    assert "gammaRay" not in secrets.pieces(spark.createDataFrame(docs, "doc_id long, text string"), 99)


# ---- SQL ----


@pytest.mark.parametrize("name", ["op12_conversation_repair", "op13_filter_audit"])
def test_equals_sql(spark, small, name):
    con = duckdb.connect()
    for t in ("documents", "labels", "conversations"):
        con.execute(f"create view {t} as select * from '{small}/{t}.parquet'")
    want = con.sql(queries.oracle_sql()[name]).df()
    got = queries.queries()[name](spark, small).toPandas()
    keys = list(want.columns[:3])
    assert sorted(want.columns) == sorted(got.columns)
    a, b = want.sort_values(keys).reset_index(drop=True), got[want.columns].sort_values(keys).reset_index(drop=True)
    pd.testing.assert_frame_equal(a, b, check_dtype=False)


def test_full_stops_without_a_blank_are_no_addresses():
    from lexiscape.llm import pii

    for t in ("see us at home.no one came", "meet at noon.it was good", "look at me.is it so", "we left at dawn.so did they"):
        assert pii.spans(t)[1] == [], t
    for t, n in (("write to john at example.it", 27), ("mail john at example.no, please", 23), ("john at example.com today", 19), ("john at mail dot example.it was", 27), ("john (at) example.it was", 20)):
        assert [e for _, e, k in pii.spans(t)[1] if k == "email"] == [n], t
