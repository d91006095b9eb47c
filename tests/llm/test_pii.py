import datetime
import hashlib
import re

from nestkit.llm.pii import CARD, DATE, DAYS, E164, IBAN, IPV4, PHONE, ROUNDS, SIDE, SSN, pseudonymise

from .cases import ROWS, documents, empty

KEY = "a key of the tests"


def feistel(symbols, radices, tweak, key=KEY):
    acc, half = list(symbols), len(symbols) // 2
    for i in range(1, ROUNDS + 1):
        other = acc[half:] if i % 2 else acc[:half]
        new = []
        for j, v in enumerate(acc):
            if (j < half) == (i % 2 == 1):
                inner = hashlib.sha256((key + "|".join([tweak, str(i), str(j), ",".join(map(str, other))])).encode()).hexdigest()
                v = (v + int(hashlib.sha256((key + inner).encode()).hexdigest()[:12], 16)) % radices[j]
            new.append(v)
        acc = new
    return acc


def luhn(digits):
    return sum(int(c) if k % 2 == 0 else sum(map(int, str(2 * int(c)))) for k, c in enumerate(reversed(digits))) % 10 == 0


def mod97(iban):
    return int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97


def run(spark, texts, **options):
    rows = [(i, t, "en", "s", 1) for i, t in enumerate(texts)]
    return [r.text for r in sorted(pseudonymise(documents(spark, rows), **{"key": KEY, **options}).collect(), key=lambda r: r.doc_id)]


def test_against_brute_force(spark):
    cards = ["4111111111111111", "5500005555555559", "371449635398431"]
    got = run(spark, [f"pay {c} now" for c in cards] + ["10.20.30.40", "2001-02-03"])
    for c, g in zip(cards, got):
        body = feistel([int(x) for x in c[1:-1]], [10] * (len(c) - 2), "card")
        want = c[0] + "".join(map(str, body))
        check = next(d for d in "0123456789" if luhn(want + d))
        assert g == f"pay {want}{check} now"
    assert got[3] == ".".join(map(str, feistel([10, 20, 30, 40], [256] * 4, "ipv4")))
    first, x = datetime.date(1900, 1, 1), (datetime.date(2001, 2, 3) - datetime.date(1900, 1, 1)).days
    while True:
        a, b = feistel([x // SIDE, x % SIDE], [SIDE, SIDE], "ymd")
        x = a * SIDE + b
        if x < DAYS:
            break
    assert got[4] == str(first + datetime.timedelta(days=x))


def test_formats_stay_valid(spark):
    texts = ["4111-1111 1111-1111", "+1 (856) 555-5105", "856.555.5105", "123-45-6789", "8.8.8.8", "1999-12-31", "12/31/1999", "31/12/1999", "31.12.1999", "DE89 3704 0044 0532 0130 00", "GB82WEST12345698765432", "jo.doe9+x@example.org"]
    got = run(spark, texts)
    assert all(a != b for a, b in zip(texts, got))
    assert luhn(re.sub(r"\D", "", got[0])) and re.fullmatch(r"4\d{3}-\d{4} \d{4}-\d{4}", got[0])
    for k in (1, 2):
        assert re.fullmatch(PHONE, got[k])
    assert got[1].startswith("+1 (") and re.fullmatch(r"\d{3}\.\d{3}\.\d{4}", got[2])
    assert re.sub(r"\D", "", got[1])[1:] == re.sub(r"\D", "", got[2])  # one number, two layouts, one pseudonym
    assert re.fullmatch(SSN, got[3]) and got[3][:3] not in ("000", "666") and got[3][0] != "9"
    assert re.fullmatch(IPV4, got[4]) and all(int(o) <= 255 for o in got[4].split("."))
    datetime.date.fromisoformat(got[5])
    datetime.datetime.strptime(got[6], "%m/%d/%Y")
    assert datetime.datetime.strptime(got[7], "%d/%m/%Y").day > 12
    datetime.datetime.strptime(got[8], "%d.%m.%Y")
    for k in (9, 10):
        assert mod97(got[k].replace(" ", "")) == 1 and got[k][:2] == texts[k][:2] and re.fullmatch(IBAN, got[k])
    assert re.fullmatch(r"[a-z]{2}\.[a-z]{3}\d\+[a-z]@example\.org", got[11])
    assert re.fullmatch(DATE, got[5]) and re.fullmatch(CARD, got[0])


def test_invalid_values_stay(spark):
    texts = ["4111 1111 1111 1112", "666-12-1234", "123-00-4567", "300.1.1.1", "01.2.3.4", "2021-02-30", "13/13/2020", "DE89370400440532013001", "0000000000000000", "v1.2.3.4", "a@b", "1899-12-31", "order id 2345678901", "+1234567", "1:2:3:4:5:6:7"]
    assert run(spark, texts) == texts


def test_values_beside_others(spark):
    """The value inside is replaced as it is alone, and what stands beside it stays."""
    card, grouped, iban, other = "4111111111111111", "4111 1111 1111 1111", "ES9121000418450200051332", "BE68539007547034"
    alone = run(spark, [card, grouped, iban, other])
    assert all(a != b for a, b in zip(alone, [card, grouped, iban, other]))
    cases = [(0, "{} 12/27"), (1, "{} 123"), (0, "05/27 {}"), (0, "10:15 {}"), (2, "{} AND"), (3, "{} BE71096123456769")]
    got = run(spark, [form.format([card, grouped, iban, other][k]) for k, form in cases])
    for (k, form), g in list(zip(cases, got))[:5]:
        assert g == form.format(alone[k])
    first, second = got[5].split()
    assert first == alone[3] and second != "BE71096123456769" and mod97(second) == 1
    more = run(spark, [f"12345 {grouped}", f"{card} {card}", f"AT61 1904 3002 3457 3201 ASAP {other} EUR 500"])
    assert more[0] == f"12345 {alone[1]}" and more[1] == f"{alone[0]} {alone[0]}" and more[2].endswith(f" ASAP {alone[3]} EUR 500") and not more[2].startswith("AT61 1904 3002")
    stay = ["4111111111111112 12/27", "ES9121000418450200051333 AND"]
    assert run(spark, stay) == stay


def test_international_numbers_and_ipv6(spark):
    texts = ["+44 20 7946 0958", "+49 30 901820", "+1 (123) 555-0199", "+352 621 123 456", "2001:0db8:0000:0000:0000:ff00:0042:8329"]
    got = run(spark, texts)
    assert all(a != b and len(a) == len(b) for a, b in zip(texts, got))
    assert all(re.fullmatch(E164, g) for g in got[:4]) and [g.split()[0] for g in got[:4]] == ["+44", "+49", "+1", "+352"]
    rest = feistel([int(c) for c in "2079460958"], [10] * 10, "e16444")
    assert re.sub(r"\D", "", got[0]) == "44" + "".join(map(str, rest))
    assert re.fullmatch(r"[0-9a-f]{4}(:[0-9a-f]{4}){7}", got[4])


def test_query_key(spark, tmp_path):
    from nestkit.llm.pii import op7_pii

    documents(spark, [(1, "call 856-555-5105 now", "en", "s", 1)]).write.parquet(str(tmp_path / "documents.parquet"))
    a, b = (op7_pii(spark, str(tmp_path)).first().text for _ in range(2))
    spark.conf.set("spark.nestkit.pii.key", KEY)
    c, d = (op7_pii(spark, str(tmp_path)).first().text for _ in range(2))
    spark.conf.unset("spark.nestkit.pii.key")
    assert c == d == run(spark, ["call 856-555-5105 now"])[0] and a != b


def test_permutation_is_one_to_one_and_keyed(spark):
    days = [str(datetime.date(2000, 1, 1) + datetime.timedelta(days=k)) for k in range(800)]
    got = run(spark, [" ".join(days), " ".join(days)])
    assert got[0] == got[1] and len(set(got[0].split())) == 800
    assert run(spark, [days[0]], key="other") != run(spark, [days[0]])
    d_first = [f"{d:02d}/{m:02d}/2011" for m in range(1, 13) for d in range(13, 29)]
    out = run(spark, [" ".join(d_first)])[0].split()
    assert len(set(out)) == len(d_first) and all(int(x[:2]) > 12 for x in out)


def test_text_around_stays(spark):
    text = "Start 8.8.8.8, then\n4111111111111111$$$ and a@example.com!\n" * 3
    got = run(spark, [text])[0]
    assert re.sub(r"[\w.+-]+@example|\d", "#", got).count("\n") == text.count("\n")
    assert got.split("\n")[0] == got.split("\n")[2] and "$$$ and " in got and got.startswith("Start ")


def test_edge_rows(spark):
    got = pseudonymise(documents(spark), key=KEY).collect()
    assert sorted([(r.doc_id, r.text) for r in got], key=str) == sorted([(r[0], r[1]) for r in ROWS], key=str)
    assert all(r.found == r.changed == 0 for r in got) and pseudonymise(empty(spark), key=KEY).count() == 0


def test_no_python_on_the_main_path(spark):
    plan = pseudonymise(documents(spark), key=KEY)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan
