import re

from pyspark.sql import functions as F

from tarnsearch.llm import pii

KEY = "a test's key"

ROWS = [
    (1, "Write to jane.doe@corp.example or JANE.DOE@corp.example, tel +1 (415) 555-0134.", "x"),
    (2, "Mr. John Smith met Mrs Mary Jones; Mr Smith paid with 4111 1111 1111 1111 from 10.20.30.40.", "x"),
    (3, "Господин Иван Петров и jane.doe@corp.example; token = \"9f86d081884c7d659a2feaa0c55ad015a3bf4f1b\"", "x"),
    (4, "Nothing to see, costs $5 and 3.14.", "x"),
    (None, "IBAN DE89 3704 0044 0532 0130 00, ssn 078-05-1120, odd marks 10.20.30.40", "x"),
    (5, None, "x"), (6, "", "x"), (4, "Nothing to see, costs $5 and 3.14.", "x"),
]
ORIGINALS = ["jane.doe@", "JANE.DOE@", "555-0134", "John", "Smith", "Mary", "Jones", "4111 1111 1111 1111", "10.20.30.40", "Иван", "Петров", "9f86d081884c7d", "DE89 3704", "078-05-1120"]


def test_surrogates_keep_types_formats_and_identity(spark):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string, kind string")
    got = pii.replace(docs, KEY, count_col="n").collect()
    assert len(got) == len(ROWS)
    by = {r["doc_id"]: r["text"] for r in got}
    for original in ORIGINALS:
        assert not any(original in (t or "") for t in by.values()), original
    assert by[4] == ROWS[3][1] and by[5] is None and by[6] == ""
    mails = re.findall(r"[\w.]+@[\w.]+\.example", by[1]) + re.findall(r"[\w.]+@[\w.]+\.example", by[3])
    assert len(mails) == 3 and len({m.lower() for m in mails}) == 1 and mails[1].isupper() == mails[1].isupper()
    assert re.search(r"tel \+1 \(\d{3}\) \d{3}-\d{4}\.$", by[1])
    m = re.fullmatch(r"Mr\. (\w+) (\w+) met Mrs (\w+) (\w+); Mr (\w+) paid with (\d{4} \d{4} \d{4} \d{4}) from (\d+\.\d+\.\d+\.\d+)\.", by[2])
    assert m and m[2] == m[5] and len({m[1], m[2], m[3], m[4]}) == 4
    assert re.match(r"Господин [А-Я][а-я]+ [А-Я][а-я]+ и ", by[3]) and re.search(r'"[0-9a-f]{40}"', by[3])
    assert "odd marks " + m[7] in by[None] and re.search(r"IBAN DE\d\d \d{4} \d{4} \d{4} \d{4} \d\d, ssn \d{3}-\d\d-\d{4}", by[None])
    assert sorted(r["n"] for r in got) == [0, 0, 0, 0, 3, 3, 4, 7]
    assert sorted(map(str, got)) == sorted(map(str, pii.replace(docs.repartition(5), KEY, count_col="n").collect()))


def test_collisions_are_resolved(spark):
    rows = spark.createDataFrame([("S", f"{i:03d}") for i in range(400)] + [("A", f"10.0.{i // 250}.{i % 250}") for i in range(400)], "kind string, norm string")
    got = pii.assign(rows, KEY).collect()
    assert len({(r["kind"], r["norm"]) for r in got}) == 800
    own = {(r["kind"], r["norm"]) for r in got}
    assert len({(r["kind"], r["surrogate"]) for r in got}) == 800
    assert not any((r["kind"], r["surrogate"]) in own for r in got)


def test_what_random_draws_leave_is_given_unused_values(spark, monkeypatch):
    monkeypatch.setattr(pii, "MAX_DRAWS", 1)
    letters = "abcdefghijklmnopqrstuvwxyz"
    rows = [("S", f"{i:03d}") for i in range(400)] + [("S", str(i)) for i in range(10)] + [("E", f"{a}{b}@qv.org") for a in letters[:23] for b in letters] + [("P", f"+4{i}") for i in range(7)]
    got = pii.assign(spark.createDataFrame(rows, "kind string, norm string"), KEY).collect()
    assert sorted((r["kind"], r["norm"]) for r in got) == sorted(rows)
    assert len({(r["kind"], r["surrogate"]) for r in got}) == len(rows)
    assert not {(r["kind"], r["surrogate"]) for r in got} & set(rows)
    for r in got:
        full = len(r["norm"]) == 1 or r["kind"] == "P"
        assert full or len(r["surrogate"].split("@")[0]) == len(r["norm"].split("@")[0])
    # A format that is full: the longer surrogates stay whole in the text.
    docs = spark.createDataFrame([(1, "s")], "doc_id long, text string")
    laid = docs.select(pii.lay_out(F.lit("S"), F.lit("1-2"), F.lit("345")).alias("x")).first()["x"]
    assert laid == "3-45"


def test_secrets_and_addresses_of_letters_alone_and_of_any_length(spark):
    secrets = [
        "sk-abcdefghijklmnopqrstuvwx", "sk-" + "abcde_fghij-" * 12 + "k", "ghp_" + "abcdef" * 6, "gho_" + "aB" * 30, "AKIA" + "ABCDEFGH" * 2, "0a" * 100,
        "abcd:abcd:abcd:abcd:abcd:abcd:abcd:abcd", "2001:db8::1", "fe80::", "::1", "dead::beef", "1:2:3:4:5:6::8", "::ffff:192.0.2.77",
    ]
    clean = ["std::cout << x", "see: this, and: that", "Ratio 3:4", "ask-me-about-something"]
    rows = [(i, f"It is {t} here.") for i, t in enumerate(secrets + clean)]
    got = {r["doc_id"]: r for r in pii.replace(spark.createDataFrame(rows, "doc_id long, text string"), KEY, count_col="n").collect()}
    for i, secret in enumerate(secrets):
        assert got[i]["n"] == 1 and secret not in got[i]["text"], secret
        assert re.fullmatch(r"It is \S+ here\.", got[i]["text"])
        tail = secret if "." not in secret else secret.rpartition(":")[2]
        assert tail not in got[i]["text"]
    assert "fghij" not in got[1]["text"] and "0a0a" not in got[5]["text"]
    for i in range(len(secrets), len(rows)):
        assert got[i]["n"] == 0 and got[i]["text"] == rows[i][1]


def test_edges(edge, none):
    got = pii.replace(edge, KEY)
    assert got.columns == edge.columns and sorted(map(str, got.collect())) == sorted(map(str, edge.collect()))
    assert pii.replace(none, KEY).count() == 0


def test_mentions_scripts_and_check_digits(spark):
    rows = [
        (1, "John Smith called. Later John wrote, and Smith agreed; Smithson did not."),
        (2, "Mr. O'Brien met Mr. Jean-Luc Picard. Picard left; Jean-Luc stayed."),
        (3, "Пишите на пётр@почта.рф сегодня"),
        (4, "Card 4111 1111 1111 1111, account DE89 3704 0044 0532 0130 00."),
        (5, "Smith and John are names of others here."),
    ]
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "row long, text string, marked string")
    out = pii.replace(docs, KEY, id_col="row")
    assert out.columns == docs.columns
    got = {r["row"]: r["text"] for r in out.collect()}
    m = re.fullmatch(r"(\w+) (\w+) called\. Later (\w+) wrote, and (\w+) agreed; Smithson did not\.", got[1])
    assert m and m[1] == m[3] != "John" and m[2] == m[4] != "Smith"
    m = re.fullmatch(r"Mr\. (\S+) met Mr\. (\S+) (\S+)\. (\S+) left; (\S+) stayed\.", got[2])
    assert m and m[3] == m[4] and m[2] == m[5] and not re.search("Brien|Jean|Luc|Picard", got[2])
    assert re.fullmatch(r"Пишите на [а-я]{4}@[а-я]{5}\.рф сегодня", got[3]) and "почта" not in got[3]
    card = re.sub(" ", "", re.search(r"Card ([\d ]+),", got[4])[1])
    assert card != "4111111111111111" and sum(sum(divmod(int(c) * (1 + k % 2), 10)) for k, c in enumerate(reversed(card))) % 10 == 0
    iban = re.sub(" ", "", re.search(r"account ([A-Z\d ]+)\.", got[4])[1])
    assert iban[:2] == "DE" and int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97 == 1
    assert got[5] == rows[4][1]
    assert pii.replace(docs, "another key", id_col="row").where("row = 4").first()["text"] != got[4]
