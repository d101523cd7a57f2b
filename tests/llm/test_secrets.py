import hashlib
import math
import random
import re
import time
import uuid

from pyspark.sql import functions as F

from sonoloom.llm import secrets

SCHEMA = "doc_id long, text string, spans string, fixed string"
ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)


def slow_fixed(text):
    text = text or ""
    out = [(m.start(), 1, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    out += [(m.start(), 2, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    out += [(m.start(), 3, m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(out)


def listed(spans):
    return ",".join(f"{secrets.KINDS[k - 1]}:{a}:{b}" for a, k, b in spans)


def cases():
    rng = random.Random(6)
    b64 = lambda n: "Aa1" + "".join(rng.choice(secrets.ENCODINGS["base64"][0]) for _ in range(n - 3))
    hexa = lambda n: "".join(rng.choice("0123456789abcdef") for _ in range(n))
    made = ["password=token: abcdefgh", "PASSWORD = 'ab.c-d'", 'api_key":"xxxxxx', "apikey:12345", "ſecret=abcdefg", "token==abcdef secret=secret=abcdef", "AKIA" + "A1" * 8, "AKIAAKIA" + "Z" * 11]
    rows = [(None, None), (1, ""), (2, "\U0001f600é token= \"" + hexa(40) + '"'), (2, "\U0001f600é plain"), (3, "x " * 60_000 + hexa(24))]
    for i in range(150):
        parts = ["wörter"] * rng.randint(0, 5) + [rng.choice(made), rng.choice(made)] + [b64(rng.randint(20, 90)), hexa(rng.randint(20, 60)), "Ordinary-Words-in-Slug-Form-2024-like-this-one-Here"]
        rng.shuffle(parts)
        rows.append((10 + i, rng.choice([" ", "\n", " \U0001f600 "]).join(parts)))
    return rows, b64


def found_in(spark, rows):
    docs = spark.createDataFrame([(*r, "clash", "clash") for r in rows], SCHEMA)
    seen, fixed, every = secrets.scan(docs, drop=False)
    return [(r[0], r[1], [tuple(s) for s in r[2]], [tuple(s) for s in r[3]]) for r in seen.select("doc_id", "text", fixed, every).collect()]


def test_fixed_spans_match_brute_force_and_random_ones_are_free(spark):
    rows, _ = cases()
    tokens = slugs = 0
    for _, text, base, found in found_in(spark, rows):
        assert base == slow_fixed(text)
        assert [s for s in found if s[1] < 4] == base and found == sorted(found)
        for a, k, b in found:
            if k == 4:
                token = text[a:b]
                assert re.fullmatch(secrets.TOKEN, token) and not any(s < b and a < e for s, _, e in base)
                slugs += "Ordinary" in token
                tokens += 1
    assert tokens >= 120 and slugs == 0


def slow_tail(x):
    return 0.5 if x < 0.8 else max(1e-15, math.exp(-x * x / 2) / (x * math.sqrt(2 * math.pi)))


def slow_reading(token):
    kinds = [("digits", "[0-9]+"), ("lower", "[a-z]+"), ("upper", "[A-Z]+"), ("hex", "[0-9a-f]+|[0-9A-F]+"), ("letters", "[A-Za-z]+"), ("lower32", "[a-z2-7]+"), ("upper32", "[A-Z2-7]+"), ("lower36", "[a-z0-9]+"), ("upper36", "[A-Z0-9]+")]
    name = next((n for n, k in kinds if re.fullmatch(k, token)), "base64")
    alphabet, classes, slope, level, spread = secrets.ENCODINGS[name]
    token = token.lower() if name == "hex" else token.replace("-", "+").replace("_", "/")
    x, g, n, k = [alphabet.index(c) + 1 for c in token], [classes[alphabet.index(c)] for c in token], len(token), len(alphabet)
    normal = lambda chi, df: ((chi / df) ** (1 / 3) - (1 - 2 / (9 * df))) / math.sqrt(2 / (9 * df))
    shares = {c: classes.count(c) / k for c in set(classes)}
    u = normal(sum((x.count(i) - n / k) ** 2 / (n / k) for i in range(1, k + 1)), k - 1)
    v = normal(sum((g.count(c) - n * p) ** 2 / (n * p) for c, p in shares.items()), len(shares) - 1)
    q, cubes, runs = sum(p * p for p in shares.values()), sum(p**3 for p in shares.values()), 1 + sum(a != b for a, b in zip(g, g[1:]))
    r = (1 + (n - 1) * (1 - q) - runs) / math.sqrt((n - 1) * q * (1 - q) + 2 * (n - 2) * (cubes - q * q))
    mean = sum(x) / n
    own = sum((i - mean) ** 2 for i in x)
    s = (sum((i - mean) * (j - mean) for i, j in zip(x, x[1:])) / own + 1 / n) * math.sqrt(n) if own > 1e-6 else 99.0
    half = -sum(math.log(2 * slow_tail(abs(z))) for z in (u, v, r, s))
    if math.exp(-half) * (1 + half + half**2 / 2 + half**3 / 6) < secrets.STRUCTURED:
        return 1.0
    return slow_tail((slope * math.sqrt(n) + level - u - v - r - abs(s)) / (spread * (n / 20) ** 0.25))


def slow_p(token):
    bare = token.replace("-", "")
    readings = [token] + [max(found, key=len) for p in ("[0-9A-Za-z]{20,}", "[0-9a-z]{20,}", "[0-9A-Z]{20,}", "[0-9a-f]{20,}|[0-9A-F]{20,}") if (found := re.findall(p, token))]
    readings += [bare] if re.fullmatch("[0-9a-fA-F]+(-[0-9a-fA-F]+)+", token) and len(bare) >= 20 else []
    return min(1.0, min(map(slow_reading, set(readings))) * len(set(readings)))


def drawn(rng):
    return {name: "".join(rng.choice(a[0]) for _ in range(rng.randint(20, 80))) for name, a in secrets.ENCODINGS.items()}


def test_battery_matches_brute_force(spark):
    rng = random.Random(8)
    tokens = ["a1" * 20, "Ab1" + "a" * 30, "A2" * 11, "0f" * 10, "AAAAAAAAAAAAAAAAAAA7", "a" * 20, "7" * 25, "key_" + "0a" * 12, str(uuid.UUID(int=rng.getrandbits(128))), "abcdefghijklmnopqrstuvwxyz0123456789"]
    tokens += [t for _ in range(12) for t in drawn(rng).values()] + ["live-" + t for t in drawn(rng).values()]
    df = spark.createDataFrame([(t.replace("+", "-"),) for t in tokens], "text string")
    rows = df.select("text", F.explode(secrets.tested(F.col("text"))).alias("t")).collect()
    assert len(rows) == len(tokens)
    for r in rows:
        assert abs(r.t.p - slow_p(r.text)) <= 1e-6 * r.t.p + 1e-14, r.text


def test_step_up_matches_brute_force(spark):
    rng = random.Random(4)
    found = [(rng.randint(20, 120), 10 ** -rng.choice([rng.uniform(0, 1), rng.uniform(0, 9)])) for _ in range(3000)]
    got = secrets.decide(spark.createDataFrame(found, "length int, p double"))
    for c, (low, high) in enumerate([(20, 32), (32, 64), (64, 10**9)]):
        bins = [min(150, math.floor(-10 * math.log10(p))) for n, p in found if low <= n < high]
        cuts = [b for b in set(bins) if 10 ** (-b / 10) * len(bins) <= secrets.LEVEL * sum(x >= b for x in bins)]
        assert got.bins[c] == min(cuts)
    assert secrets.decide(spark.createDataFrame([(25, 1.0)], "length int, p double")).bins == [None, None, None]


NAMED = "getUserAccountByEmailV2 HttpRequestHandlerFactory2 src/main/java/App1Controller Quarterly-Sales-Report-2024-Final testShouldReturn404WhenMissing UTF8StringEncodingConverter MainActivity2ViewModelProvider com/example/service/impl/UserServiceImpl2"
WORDS = """account action address adapter array asset async audit backup balance batch binary block branch bridge buffer build button cache calendar
    campaign catalog channel chapter check client cloud cluster column command config connect content context control convert counter country create credit
    customer daily data database debug decode default delete delivery deploy design detail device dialog directory discount document domain download driver
    editor email encode engine entity error event example export factory feature field file filter final finance folder format forward frame gateway global
    group handler header health history image import index input instance invoice java job journal key language layout legacy level library limit line link
    list load local location log login main manager map market master media member memory merge message method metric migration mobile model module monitor
    month network node notify number object offer online option order output package page parser partner path payment person phone pipeline plan platform
    player plugin policy pool portal process product profile project provider proxy public purchase query queue quick range record region release remote
    report request resource response result return review route runner sample schedule schema score screen script search section segment select sender series
    server service session setting shadow shape share signal simple single source stage start state static status storage store stream string style summary
    support switch system table target task team template test theme thread ticket timer token tool topic total trace track transfer tree trigger type update
    upload user utility validate value vendor version video view virtual visit volume warehouse web widget window work worker writer year zone""".split()


def labelled(rng, n):
    """(token, is it a key): identifiers, paths and slugs, and keys of 20 to 200 characters."""
    out = [(t, False) for t in NAMED.split()]
    while len(out) < n:
        w = [rng.choice(WORDS) for _ in range(rng.randint(3, 12))]
        number = str(rng.choice([rng.randint(0, 9), rng.randint(2000, 2030), rng.randint(100, 99999)]))
        t = rng.choice([
            w[0] + "".join(map(str.capitalize, w[1:])), "".join(map(str.capitalize, w)) + number, "-".join([*w, number]), "-".join(map(str.capitalize, [*w, number])),
            "/".join(w) + "/" + w[0].capitalize() + number, "_".join(w), "_".join(w).upper(), "".join(w), w[0] + number + "".join(w[1:]), f"v{number}/" + "/".join(w) + "/" + number,
        ])
        if 20 <= len(t) <= 200:
            out.append((t, False))
    for _ in range(n // 4):
        length = rng.randint(20, 200)
        alphabet = secrets.ENCODINGS[rng.choice(["hex", "upper32", "lower36", "upper36", "letters", "base64", "base64"])][0].replace("+", "-")
        out.append((rng.choice(["", "", "", "sk_live_", "ghp_"]) + "".join(rng.choice(alphabet) for _ in range(length)), True))
    out += [(str(uuid.UUID(int=rng.getrandbits(128), version=4)), True) for _ in range(n // 40)]
    rng.shuffle(out)
    return out


def test_labelled_set_of_identifiers_and_keys(spark):
    rng = random.Random(17)
    tokens = labelled(rng, 3000)
    rows = [(i, f"see {t} here") for i, (t, _) in enumerate(tokens)]
    spans = {i: every for i, _, _, every in found_in(spark, rows)}
    caught = [(key, any(k == 4 or key for _, k, _ in spans[i])) for i, (_, key) in enumerate(tokens)]
    right, flagged, keys = sum(k and c for k, c in caught), sum(c for _, c in caught), sum(k for k, _ in caught)
    print("precision", right / flagged, "recall", right / keys)
    assert right / flagged >= 0.9 and right / keys >= 0.9
    assert not any(spans[i] for i, (t, _) in enumerate(tokens) if t in NAMED.split())


def test_long_tokens_and_many_matches_take_time_in_proportion(spark):
    rng = random.Random(9)
    long = "".join(rng.choices(secrets.ENCODINGS["base64"][0], k=1_000_000))
    many = " ".join("".join(rng.choices("0123456789abcdef", k=26)) for _ in range(40_000))
    slugs = [(10 + i, f"Ordinary-Words-in-Slug-Form-{i}-like-this-one") for i in range(200)]
    began = time.time()
    found = {i: (base, every) for i, _, base, every in found_in(spark, [(1, "data: " + long), (2, many), *slugs])}
    assert time.time() - began < 60
    assert found[1][1] == [(6, 4, 6 + len(long))] and found[2][0] == slow_fixed(many) and not any(found[10 + i][1] for i in range(200))


def test_keys_of_every_kind_are_found_among_text(spark):
    rng = random.Random(10)
    low, up, digits = secrets.LOWER, secrets.UPPER, secrets.DIGITS
    draw = lambda a, n: "".join(rng.choice(a) for _ in range(n))
    hexa = lambda n: "0a" + draw("0123456789abcdef", n - 2)
    kinds = {
        "base36": lambda: draw(low + digits, 32), "base32": lambda: draw(low + "234567", 40), "upper": lambda: draw(up + digits, 32), "letters": lambda: draw(low + up, 30),
        "no digit": lambda: draw(low + up + "+/", 24), "prefix": lambda: "key_" + hexa(23), "uuid": lambda: str(uuid.UUID(int=rng.getrandbits(128), version=4)), "behind": lambda: "live_" + draw(low + digits, 36),
    }
    keys = [(k, make()) for k, make in kinds.items() for _ in range(20)]
    text = ["ordinary-words-in-slug-form-like-this-one", "usr/local/share/some/path/of/words", "a_name_of_some_function_in_code", "GetElementsByNameOrClassOrTag", "--------------------------", "2024-01-02-03-04-05-2024-01-02", "12345678901234567890123"]
    rows = [(i, f"x {k} y") for i, (_, k) in enumerate(keys)] + [(1000 + i, " ".join(text)) for i in range(20)]
    found = {i: every for i, _, _, every in found_in(spark, rows)}
    assert not any(found[1000 + i] for i in range(20))
    for kind in kinds:
        hits = [(2, 4, 2 + len(k)) in found[i] for i, (name, k) in enumerate(keys) if name == kind]
        assert sum(hits) >= 16, (kind, sum(hits))


def test_redaction_and_empty_table(spark):
    rows = [(1, 'a token = "0123456789abcdef0123456789abcdef" é'), (2, None), (3, "clean"), (3, "clean")]
    docs = spark.createDataFrame([(*r, "s", "f") for r in rows], SCHEMA)
    out = secrets.redact(docs)
    assert out.columns == docs.columns
    assert sorted((r.doc_id, str(r.text), r.spans, r.fixed) for r in out.collect()) == [(1, 'a [SECRET]" é', "s", "f"), (2, "None", "s", "f"), (3, "clean", "s", "f"), (3, "clean", "s", "f")]
    assert secrets.redact(docs.limit(0)).count() == 0


def test_query(spark, sf):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = secrets.query(spark, sf).collect()
    assert len(rows) == len(texts)
    for r in rows:
        base = slow_fixed(texts[r.doc_id])
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(k == i for _, k, _ in base) for i in (1, 2, 3))
        assert r.base_sha256 == hashlib.sha256(listed(base).encode()).hexdigest()
        assert ",".join(s for s in r.spans.split(",") if not s.startswith("random")) == listed(base)


def test_forty_thousand_matches_are_redacted(spark):
    text = " ".join(f"é😀 password = abcdef{i:06d}" for i in range(40_000))
    docs = spark.createDataFrame([(1, text), (2, None), (3, "")], "doc_id long, text string")
    got = {r.doc_id: r.text for r in secrets.redact(docs).collect()}
    assert got == {1: " ".join(["é😀 [SECRET]"] * 40_000), 2: None, 3: ""}
