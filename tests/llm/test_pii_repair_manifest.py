"""Personal data, conversation repair and the Merkle manifest against brute-force versions on awkward rows."""

import hashlib
import random
import re
import zlib
from itertools import groupby

import pandas as pd
import pytest
from pyspark.sql import functions as F

from valuary.llm import op11_pii, op12_conversation_repair, op13_merkle_manifest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row string, kind int, start int, hash int, pos string"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# ---------------------------------------------------------------------------------------------------------------- PII

PII_TEXTS = [
    "mail me: a.b+c@mail5.example.com, or x@y or @z.org or a@b@c.de.", "a@b.c_d@e.f.g a@b.c.@h.i", "é 🙂 jo@ex.com 🙂 1.2.3.4",
    "host 10.0.0.1 and 256.1.1.1 and 1.2.3.4.5.6.7.8 and 001.02.3.0255 and 1.2.3", "9" * 30 + ".1.1.1 " + "1" * 5000,
    "card 4465758382889437 or 4465 7583-8288 9437 or 4465758382889438 or 4465  758382889437",
    "amex 378282246310005 here; order 378282246310005 there", "378282246310005", "x" * 300 + " visa 30569309025904",
    "+1 (523) 555-1055 and +49 30 1234567890123456 and +1-2 and ++44 20 7946 0958.", "phone (523) 555-1055, " + "y" * 80 + " 523 555 1055",
    "IBAN DE89 3704 0044 0532 0130 00, GB82WEST12345698765432; DE88 3704 0044 0532 0130 00", "iban:GB82WEST12345698765432X",
    "ssn 078-05-1120", "078-05-1120 alone", "test order example: ssn 078-05-1120", "a@" + "b." * 9000 + "c " + "q" * 9000 + "@r.st",
    None, "", " ", "tel 5551234567 call 10.20.30.40 card", "hotel 5551234567", "+" * 500 + "1 2345678", "1 " * 9000,
    "ip 4465.75.3.4 4.4.4.4-4465758382889437", "a@b.co " * 400 + "1.1.1.1 " * 300,
]


def brute_pii(text):
    """Base spans by the stated rules, added ones by the module's, each found with Python's regular expressions."""
    text = text or ""
    scores = op11_pii.Scores()
    marks, spans = [], []

    def luhn(digits):
        return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(digits))) % 10 == 0

    def mod97(s):
        s = re.sub("[^A-Z0-9]", "", s)
        return int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1

    digits = lambda s: re.sub("[^0-9]", "", s)
    ok = {
        "email": lambda s: True,
        "ip": lambda s: all(int(x) <= 255 for x in s.split(".")),
        "card": lambda s: 16 <= len(digits(s)) <= 19 and luhn(digits(s)),
        "phone": lambda s: 8 <= len(digits(s)) <= 15,
        "iban": mod97,
        "short_card": lambda s: 12 <= len(digits(s)) <= 15 and luhn(digits(s)),
        "national_id": lambda s: True,
        "local_phone": lambda s: 7 <= len(digits(s)) <= 12,
    }
    for i, (pattern, lead) in enumerate(op11_pii.PATTERNS):
        for m in re.finditer(pattern, " " * lead + text):
            # Behind the blank in front, a match's own first character is not part of the span.
            start, end = m.start(), m.end() - lead
            if i >= len(op11_pii.KINDS):
                marks.append((op11_pii.TOPICS[i - len(op11_pii.KINDS)], start, end))
            elif ok[op11_pii.KINDS[i]](m.group()):
                spans.append((i, start, end))
    meets = lambda a, b, reach: a[1] < b[2] + reach and b[1] < a[2] + reach
    out = []
    base = [s for s in spans if s[0] < 4]
    for s in spans:
        near = lambda topic: any(m[0] == topic and meets(m, s, scores.reach) for m in marks)  # noqa: B023, E731
        score = scores.confirmed[s[0]] + scores.near * near(scores.topic[s[0]]) - scores.doubt * near("doubt")
        apart = s[0] <= 4 or not any(meets(b, s, 0) for b in base)
        if s[0] < 4 or score >= scores.min_score and apart:
            out.append((*s, score))
    out.sort()
    said = lambda some: ",".join(f"{op11_pii.KINDS[k]}:{a}:{b}" for k, a, b, _ in some)
    counts = [sum(s[0] == k for s in out) for k in range(4)]
    return (*counts, sha(said([s for s in out if s[0] < 4])), said(out), ",".join(str(s[3]) for s in out))


def test_pii_equals_brute_force(spark):
    rows = [(i, t, "en", "s", 1, "clash", 7, 8, 9, "p") for i, t in enumerate(PII_TEXTS)] + [(None, PII_TEXTS[0]) + (None,) * 8] * 2
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    found, spans = op11_pii.pii_spans(docs, "doc_id")
    got = sorted((tuple(r) for r in op11_pii.summarise(found, spans, "doc_id").collect()), key=repr)
    want = sorted(((r[0], *brute_pii(r[1])) for r in rows), key=repr)
    assert got == want
    kinds = {s.split(":")[0] for r in got for s in r[6].split(",") if s}
    assert kinds == set(op11_pii.KINDS)


def test_pii_context_moves_the_score(spark):
    texts = ["ssn 078-05-1120", "078-05-1120 alone", "test: ssn 078-05-1120", "visa 378282246310005", "378282246310005"]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    found, spans = op11_pii.pii_spans(docs, "doc_id")
    got = {r["doc_id"]: (r["spans"], r["scores"]) for r in op11_pii.summarise(found, spans, "doc_id").collect()}
    assert got == {0: ("national_id:4:15", "60"), 1: ("", ""), 2: ("", ""), 3: ("short_card:5:20", "65"), 4: ("", "")}


def test_pii_of_an_empty_table(spark):
    found, spans = op11_pii.pii_spans(spark.createDataFrame([], SCHEMA), "doc_id")
    assert op11_pii.summarise(found, spans, "doc_id").count() == 0


def test_pii_runs_without_python_workers(spark):
    found, spans = op11_pii.pii_spans(spark.createDataFrame([(1, "a@b.cd")], "doc_id long, text string"), "doc_id")
    plan = op11_pii.summarise(found, spans, "doc_id")._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


# ------------------------------------------------------------------------------------------------------- conversations

CONVERSATION = "conv_id long, turn long, role string, text string, conv string, nth int, fault string, moves int"


def cheapest(rows):
    """(cost, initials) by trying every edit: rows are (initial, fault)."""
    after = {"": "u", "s": "u", "u": "a", "a": "u"}

    def best(i, state, inserted):
        options = []
        if i == len(rows):
            if state in ("", "a"):
                options.append((0, ""))
        else:
            initial, fault = rows[i]
            add = lambda cost, letter, rest: (cost + rest[0], letter + rest[1])
            extra = fault == "truncated"
            options.append(add(3, "D", best(i + 1, state, 0)))
            if fault not in ("blank", "duplicate"):
                if initial == after[state] or (initial == "s" and state == ""):
                    options.append(add(extra, "K", best(i + 1, initial, 0)))
                options.append(add(2 + extra, "R", best(i + 1, after[state], 0)))
        if inserted < 2:
            rest = best(i, after[state], inserted + 1)
            options.append((2 + rest[0], "I" + rest[1]))
        return min(options, default=(10**9, ""))

    return best(0, "", 0)


def brute_report(rows):
    """rows: (turn, role, text) of one conversation after nulls became blanks."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
    seen, marked = set(), []
    for turn, role, text in rows:
        solid = re.findall(r"[^\x20\x09-\x0D]", text)
        fault = "blank" if not solid else "duplicate" if (role, text) in seen else "truncated" if solid[-1] not in ".!?" else ""
        seen.add((role, text))
        marked.append((role[:1], fault))
    cost, audit = cheapest(marked)
    out, i, state = [], 0, ""
    for letter in audit:
        step = "a" if state == "u" else "u"
        if letter in "IR":
            state = step
            out.append(({"u": "user", "a": "assistant"}[step], "" if letter == "I" else rows[i][2]))
        elif letter == "K":
            state = rows[i][1][:1]
            out.append(rows[i][1:])
        i += letter != "I"
    turns = {r[0] for r in rows} - {None}
    initials = [m[0] for m in marked]
    return (
        max(turns) - min(turns) + 1 - len(turns) if turns else 0,
        *[sum(m[1] == f for m in marked) for f in ("blank", "duplicate", "truncated")],
        sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:])),
        cost, audit, sha("\n".join(f"{r}:{t}" for r, t in out)),
    )


def conversations(rng, n, longest=5):
    rows = []
    for c in range(n):
        for _ in range(rng.randrange(longest + 1)):
            turn = rng.choice([None, *range(6), 2**53 + 1])
            role = rng.choice(["user", "assistant", "system", "user", "assistant", "tool", "", None, "ümlaut"])
            text = rng.choice(["fine.", "fine!", "cut", "", " \t\n", None, "odd? \n", "é.", "tail ", "dot. ", "a:b\nc."])
            rows.append((c if c else None, turn, role, text, "x", 1, "y", 3))
    return rows


def repaired_reports(df):
    return {r["conv"]: tuple(r)[1:] for r in op12_conversation_repair.report(df).collect()}


def test_repair_equals_brute_force(spark):
    rows = conversations(random.Random(3), 500)
    got = repaired_reports(spark.createDataFrame(rows, CONVERSATION).repartition(5))
    by = {}
    for c, turn, role, text, *_ in rows:
        by.setdefault(None if c is None else str(c), []).append((turn, " " if role is None else role, " " if text is None else text))
    assert got == {c: brute_report(r) for c, r in by.items()}


def test_moves_equal_brute_force_on_all_short_conversations():
    kinds = [(i, f) for i in ("s", "u", "a", "x") for f in ("", "duplicate", "truncated")]
    rng = random.Random(8)
    samples = [[a, b] for a in kinds for b in kinds] + [[rng.choice(kinds) for _ in range(4)] for _ in range(60)]
    for rows in samples:
        frame = pd.DataFrame({"conv": "c", "role": [r[0] for r in rows], "text": "t", "turn": "1", "fault": [r[1] for r in rows]})
        back = pd.concat(op12_conversation_repair.back_pointers([frame[::-1]]))[::-1]
        done = pd.concat(op12_conversation_repair.reports(op12_conversation_repair.edits([back])))
        assert (done["cost"][0], done["audit"][0]) == cheapest(rows), rows


def test_a_giant_conversation_streams_over_many_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "100")
    try:
        roles = ["user", "assistant"]
        rows = [(1, i, roles[i % 2] if i % 7 else "system", f"{i}" + "." * (i % 5 > 0)) for i in range(3000)]
        rows += [(2, i, roles[i % 2], f"{i}.") for i in range(1000)]
        df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
        got = repaired_reports(df)
        assert got["2"] == (0, 0, 0, 0, 0, 0, "K" * 1000, sha("\n".join(f"{r[2]}:{r[3]}" for r in rows if r[0] == 2)))
        truncated = sum(r[3][-1] != "." for r in rows[:3000])
        assert got["1"][3] == truncated and len(got["1"][6]) - got["1"][6].count("I") == 3000
        written = [r for r in op12_conversation_repair.repair(df).where("conv = '1' and role is not null").select("role", "text").collect()]
        assert got["1"][7] == sha("\n".join(f"{r}:{t}" for r, t in written))
        shape = re.sub("[^sua]", "", "".join(r[0][0] for r in written))
        assert re.fullmatch("(s?(ua)+)?", shape)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_damage_and_empty_conversations(spark):
    rows = [(c, t, "assistant", "One. Two!") for c in range(60) for t in range(3)] + [(None, None, None, None)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    want = []
    for c, t, role, text in rows:
        said = [" " if v is None else str(v) for v in (c, t, role, text)]
        kind = zlib.crc32(f"{said[0]}:{said[1]}".encode()) % 20
        text = "" if kind == 1 else re.sub("[.!?]", "", said[3]) if kind == 2 else said[3]
        want += [] if kind == 0 else [(c, t, "user" if kind == 4 else said[2], text)] * (2 if kind == 3 else 1)
    got = [tuple(r) for r in op12_conversation_repair.damage(df).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert op12_conversation_repair.report(df.limit(0)).count() == 0 and op12_conversation_repair.repair(df.limit(0)).count() == 0


# ------------------------------------------------------------------------------------------------------------ manifest


def brute_tree(hashes):
    """The node at the top, and the (left, right) siblings per leaf and level."""
    paths, nodes, members = [[] for _ in hashes], list(hashes), [[i] for i in range(len(hashes))]
    while len(nodes) > 1:
        above, grouped = [], []
        for a in range(0, len(nodes), 3):
            run = nodes[a : a + 3]
            for s in range(len(run)):
                for leaf in members[a + s]:
                    paths[leaf].append(("".join(run[:s]), "".join(run[s + 1 :])))
            above.append(sha("".join(run)))
            grouped.append(sum(members[a : a + 3], []))
        nodes, members = above, grouped
    return nodes[0], paths


def brute_manifest(rows):
    def leaf(row, text):
        d, _, lang, source, n, *_ = row
        return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (d, source, lang, n, text)))

    def tampered(row):
        even = row[0] is not None and zlib.crc32(str(row[0]).encode()) % 2 == 0
        return row[1].replace("\n", "") if even and row[1] is not None else row[1]

    rows = sorted(rows, key=lambda r: (r[3] is not None, (r[3] or "").encode(), r[0] is not None, r[0] or 0, leaf(r, r[1])))
    trees = [(s, list(g)) for s, g in groupby(rows, key=lambda r: r[3])]
    subs = [brute_tree([leaf(r, r[1]) for r in g]) for _, g in trees]
    root, over = brute_tree([s[0] for s in subs])
    out = []
    for (_, g), (sub, paths), up in zip(trees, subs, over):
        for row, path in zip(g, paths):
            again = leaf(row, tampered(row))
            for left, right in path + up:
                again = sha(left + again + right)
            proof = sha("".join(a + b for a, b in path + up))
            out.append((row[0], leaf(row, row[1]), sub, root, proof, again, again == root))
    return sorted(out, key=repr)


def manifest_of(spark, rows, folder):
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{folder}/documents.parquet")
    return sorted((tuple(r) for r in op13_merkle_manifest.op13_merkle_manifest(spark, folder).collect()), key=repr)


def manifest_rows(n, seed=2):
    rng = random.Random(seed)
    rows = [
        (rng.choice([None, *range(n)]), rng.choice([None, "", "a\nb\n\nc", f"t{i}\n", f"é{i}", "x" * 5000]), rng.choice([None, "en"]),
         "hot" if i % 3 else rng.choice([None, "", "é", "z", "Z", "one" + str(i % 20)]), rng.choice([None, i]), "r", 1, 2, 3, "p")
        for i in range(n)
    ]
    return rows + rows[:40] + [rows[0]] * 30


@pytest.mark.parametrize("n", [1, 2, 4, 260])
def test_manifest_equals_brute_force(spark, tmp_path, n):
    rows = manifest_rows(n) if n > 4 else [(i, f"a\n{i}", "en", "s", 1, "r", 1, 2, 3, "p") for i in range(n)]
    got = manifest_of(spark, rows, str(tmp_path))
    assert got == brute_manifest(rows)
    assert {r[6] for r in got} == {True, False} or n < 5


def test_manifest_climbs_several_blocks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(op13_merkle_manifest, "LEVELS", 2)
    rows = manifest_rows(300, seed=4)
    assert manifest_of(spark, rows, str(tmp_path)) == brute_manifest(rows)


def test_manifest_of_an_empty_table(spark, tmp_path):
    assert manifest_of(spark, [], str(tmp_path)) == []


def test_a_changed_leaf_breaks_its_own_proof_only(spark):
    docs = spark.createDataFrame([(i, f"text {i}", None, f"s{i % 2}", 6) for i in range(9)], "doc_id long, text string, lang string, source string, n_chars long")
    proved = op13_merkle_manifest.manifest(docs, F.when(F.col("doc_id") == 4, "other").otherwise(F.col("text")))
    ok = proved.select("doc_id", (op13_merkle_manifest.folded(F.col("changed"), F.col("path")) == F.col("root")).alias("ok"))
    assert sorted(r["doc_id"] for r in ok.where("not ok").collect()) == [4]
