import hashlib
import random
import re
import string

from siltstone.llm import queries, secrets


def scan(text):
    return secrets.scan(text, secrets.Novelty(), secrets.Params())


def random_key(rng, n=40, letters=string.ascii_letters + string.digits):
    return "".join(rng.choices(letters, k=n))


def test_planted_keys_are_found():
    rng = random.Random(1)
    for _ in range(200):
        key = random_key(rng)
        for text in (f'password = "{key}"', f"the token: {key} is live", f"client_secret={key}", f"our api key is {key} since May", f"AKIA{random_key(rng, 16, string.ascii_uppercase + string.digits)} in a log"):
            got = scan("Some prose before it. " + text + " And prose after it.")
            assert len(got) == 1, text


def test_placeholders_prose_and_plain_hashes_are_not():
    for text in ('password = "changeme"', "password = your_password_here", "token: undefined", "api_key = XXXXXXXXXXXXXXXX", "the secret of the old house was kept for many years", 'secret = "os.environ"', "token = aaaaaaaaaaaaaaaaaaaaaaaa", "commit 04dbebab91ab85687d33eeaaf9ac699e1188f962 fixed it"):
        assert scan(text) == [], text


def test_a_secret_given_twice_is_reported_twice():
    key = "q8Zr2LmX0vTn5KwYb7Hc"
    assert [r["offset"] for r in scan(f"token = {key} " * 3)] == [8, 37, 66]
    assert len(scan(f"password={key}\n" * 500)) == 500


def test_repetition_of_the_surroundings_costs_nothing():
    key = "q8Zr2LmX0vTn5KwYb7Hc"
    assert scan(f"token = {key}")
    assert scan(f"see {key} and {key}: token = {key}") == []


def test_fields():
    text = "é token = q8Zr2LmX0vTn5KwYb7Hc;"
    (r,) = scan(text)
    assert text[r["offset"] : r["offset"] + r["length"]] == "q8Zr2LmX0vTn5KwYb7Hc"
    assert r["sha256"] == hashlib.sha256(b"q8Zr2LmX0vTn5KwYb7Hc").hexdigest() and r["preview"] == "q8Zr..." and r["rule"] == "assigned"


def names_of(texts, p):
    """The corpus' names by plain loops."""
    counts = {}
    for t in texts:
        for name in {m[1] for m in re.finditer(secrets.ASSIGNED, t or "", re.A)}:
            counts[name] = counts.get(name, 0) + 1
    return [n for n, c in sorted(counts.items(), key=lambda x: (-x[1], x[0])) if c >= p.min_documents][: p.corpus_names]


def test_names_of_the_corpus(spark, medium):
    docs = spark.read.parquet(f"{medium}/documents.parquet")
    names = secrets.corpus_names(docs, secrets.Params())
    assert names == names_of([r.text for r in docs.collect()], secrets.Params()) and "token" in names
    rows = [(i, f"billing_gateway_endpoint = {i}, AKIA{i:016d}: x, q{i}w8e7r6t5: 1") for i in range(9)]
    assert secrets.corpus_names(spark.createDataFrame(rows, "doc_id long, text string"), secrets.Params()) == ["billing_gateway_endpoint"]


def test_corpus_names_cost_less_than_keys():
    """A value that is one of the corpus' own names is no secret; a key beside it still is."""
    name = "billing_gateway_endpoint_resolver"
    p = secrets.Params()
    assert secrets.scan(f"secret = {name}", secrets.Novelty(), p) and not secrets.scan(f"secret = {name}", secrets.Novelty([name]), p)
    assert secrets.scan("secret = q8Zr2LmX0vTn5KwYb7Hc", secrets.Novelty([name]), p)


def test_marginal_bytes_by_an_independent_computation():
    """Sizes of whole frames by the streaming interface, with the dictionary put together by hand."""
    import io

    import zstandard

    names = ["alpha_name", "beta_name"]
    primed = zstandard.ZstdCompressionDict(b"beta_name alpha_name " + secrets.DICTIONARY, dict_type=zstandard.DICT_TYPE_RAWCONTENT)

    def size(text):
        out = io.BytesIO()
        with zstandard.ZstdCompressor(level=12, dict_data=primed, write_content_size=False, write_checksum=False).stream_writer(out, closefd=False) as w:
            w.write(secrets.DICTIONARY[:160] + text.encode())
        return len(out.getvalue())

    rng = random.Random(9)
    for _ in range(50):
        before, key, after = "some text token = ", random_key(rng, rng.randint(8, 60)), " and more of it"
        assert abs(secrets.Novelty(names).marginal(before, key, after) - (size(before + key + after) - size(before + after))) <= 1


def test_query_against_brute_force(spark, medium):
    docs = spark.read.parquet(f"{medium}/documents.parquet").collect()
    novelty = secrets.Novelty(names_of([r.text for r in docs], secrets.Params()))
    want = sorted((r.doc_id, s["offset"], s["sha256"], s["marginal_bytes"]) for r in docs for s in secrets.scan(r.text, novelty, secrets.Params()))
    got = sorted((r.doc_id, r.offset, r.sha256, r.marginal_bytes) for r in queries.op9_secrets(spark, medium).collect())
    assert got == want and want


def test_every_planted_token_of_the_table(spark, medium):
    import re

    planted = {(r.doc_id, m.start(1)) for r in spark.read.parquet(f"{medium}/documents.parquet").collect() for m in re.finditer(r'token = "([0-9a-f]{40})"', r.text)}
    got = {(r.doc_id, r.offset) for r in queries.op9_secrets(spark, medium).collect()}
    assert planted <= got and planted


def test_odd_rows(odd_docs, no_docs, spark):
    assert secrets.secrets(odd_docs).collect() == []
    assert secrets.secrets(no_docs).collect() == []
    hit = spark.createDataFrame([(None, 'password = "q8Zr2LmX0vTn5KwYb7Hc"', 1)] * 2 + [(2, "x " * 500_000 + 'password = "q8Zr2LmX0vTn5KwYb7Hc"', 2)], "doc_id long, text string, offset int")
    assert sorted((r.doc_id or 0, r.offset) for r in secrets.secrets(hit).collect()) == [(0, 12), (0, 12), (2, 1_000_012)]


def test_every_run_of_the_context_is_measured():
    rng = random.Random(6)
    keys = [random_key(rng) for _ in range(3)]
    at = lambda text: {text[r["offset"] : r["offset"] + r["length"]] for r in scan(text)}
    assert at("token list: " + " ".join(keys)) == set(keys)
    assert keys[0] in at(f"token for billing-service-account-01 {keys[0]}")
    assert at(f"token\n{keys[0]}") == set()


def test_sensitive_names_inside_identifiers():
    rng = random.Random(7)
    for name in ("SECRET_KEY = '{}'", "SECRET_KEY_BASE: {}", "API_TOKEN_PROD={}", "authTokenValue = '{}'", "my_passwords.main: {}", "the SECRET_KEY here is {}"):
        key = random_key(rng)
        text = "Some prose. " + name.format(key) + " More prose."
        assert any(key == text[r["offset"] : r["offset"] + r["length"]] or key in text[r["offset"] : r["offset"] + r["length"]] for r in scan(text)), name


def test_a_plain_candidate_does_not_hide_the_novel_one_it_overlaps():
    key = "q8Zr2LmX0vTn5KwYb7Hc"
    text = "x " * 40 + "token: " + "configuration/settings/" * 12 + f"?({key})"
    assert any(text[r["offset"] :].startswith(key) for r in scan(text))
