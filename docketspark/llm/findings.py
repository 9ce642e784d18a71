"""Labelled findings for secret scans: lines with a marked value that is a secret or is not, by how the line was made.

No scanner's rule labels them. Secrets are random values in the places where credentials are written, tokens in the shape in which
services issue them, with no name beside them, and private keys; the others are what
scanners take for secrets: commit and file hashes, request ids, addresses, paths, encoded data, identifiers, placeholders, public keys, and hashes and ids that a name like a credential's is assigned.
Values and the words around them are drawn by a seed. A team that has judged its own findings passes those instead.
"""

from __future__ import annotations

import base64
import random
import string
import uuid

SCHEMA = "finding long, text string, start long, n_chars long, label int, form string"

#: fixed values: names of credentials, and the forms in which their values are written ({n} name, {v} value)
NAMES = ("token", "auth_token", "access_token", "secret", "client_secret", "password", "passwd", "pwd", "db_password", "api_key", "apikey", "aws_secret_access_key", "access_key", "private_key", "credential")
SECRET_FORMS = (
    '{n} = "{v}"', "{n} = '{v}'", "{N}={v}", "export {N}={v}", '"{n}": "{v}"', "{n}: {v}", "{n}: '{v}'", "--{n}={v}", "Authorization: Bearer {v}", "bearer {n}={v}",
    "postgres://app:{v}@db.example.com:5432/main", "https://ci:{v}@git.example.org/x.git", "https://api.example.com/v1/items?{n}={v}&page=2", 'set{n}("{v}"); {n} = "{v}"', "{n} => '{v}'",
)
#: forms of tokens that services issue, which need no name beside them ({v} token), and of private keys
TOKEN_FORMS = (
    "{v}", "deploy with {v} from now on", "curl -u {v}: https://api.example.com/v1", "I pasted {v} by mistake", "log: {v} was sent", 'use("{v}")', "key is {v}, keep it", "- {v}",
)
BLOCK_FORMS = ("-----BEGIN RSA PRIVATE KEY-----\n{v}\n-----END RSA PRIVATE KEY-----", "-----BEGIN PRIVATE KEY-----\n{v}\n-----END PRIVATE KEY-----")
OTHER_FORMS = (
    ("commit", "commit {hex40} fixed the build"), ("merge", "Merge {hex40} into main"), ("checksum", "sha256:{hex64}"), ("md5", "{hex32}  dist/archive.tar.gz"), ("integrity", '"integrity": "sha512-{b64}"'),
    ("request", "request_id={uuid} took 31 ms"), ("session", 'id: "{uuid}"'), ("etag", 'etag: "{hex32}"'), ("digest", 'digest = "{hex64}"'), ("revision", "revision: {hex40}"), ("hash", 'hash="{hex40}"'), ("build", "build {alnum} is done"),
    ("url", "see https://www.example.com/{word}/{word}/{word}-{num}.html for more"), ("mail", "write to {word}.{num}@mail{num}.example.com"), ("path", "in /usr/lib/{word}/{word}{num}/{word}.so.{num}"), ("winpath", "at C:/{Word}/{Word}{num}/{word}.txt"),
    ("dotted", "import com.example.{word}.{Word}{Word}Factory"), ("camel", "calls {word}{Word}{Word}{Word}Handler here"), ("number", "call {num}{num}{num}{num} now"), ("time", "on 2024-03-{d2}T{d2}:{d2}:{d2}.{num}Z"), ("data", "url(data:image/png;base64,{b64})"),
    ("placeholder", '{n} = "your-{word}-here"'), ("default", '{n} = "changeme-please"'), ("reference", "{n}: config.{word}.{word}"), ("lookup", "{n} = os.environ.get_{word}_{word}"), ("file", "{n} = /etc/{word}/{word}/{word}.pem"), ("empty", '{n}: "example-{word}-{word}"'),
    ("link", "{n}: https://docs.example.com/{word}/{word}/{word}"), ("port", "host {word}{num}.example.com:8080/{word}"), ("row", "row_{num}_{num}_{word}_total is odd"),
    ("name_commit", "{n}_commit = {hex40}"), ("name_commit", '{n}_commit: "{hex40}"'), ("name_sha", "{n}_sha={hex64}"), ("name_sha", "{n}-sha1: {hex40}"), ("name_id", '{n}_id = "{uuid}"'), ("name_id", "{n}_uuid: {uuid}"),
    ("name_checksum", '"{n}_checksum": "{hex32}"'), ("name_revision", "{n}.revision={hex40}"), ("name_url", '{n}_url = "https://docs.example.com/{word}/{word}{num}"'), ("name_expires", "{n}_expires = {num}{num}"),
    ("masked", "{i}xxxxxxxxxxxxxxxxxxxxxxxx"), ("masked", "set {i}your_{word}_{word}_here first"), ("public", "-----BEGIN CERTIFICATE-----\n{b64}\n{b64}\n-----END CERTIFICATE-----"), ("public", "-----BEGIN PUBLIC KEY-----\n{b64}\n-----END PUBLIC KEY-----"),
)
_SYLLABLES = ("an", "ber", "con", "da", "el", "for", "gen", "hin", "is", "jo", "ka", "li", "mer", "no", "or", "per", "qui", "re", "sta", "tion", "un", "ver", "wo", "yen", "za")


def _word(rng: random.Random) -> str:
    return "".join(rng.choice(_SYLLABLES) for _ in range(rng.randint(1, 3)))


def _of(rng: random.Random, signs: str, n: int) -> str:
    return "".join(rng.choice(signs) for _ in range(n))


def _secret(rng: random.Random) -> str:
    letters = string.ascii_letters + string.digits
    kind = rng.randrange(7)
    if kind == 0:
        return _of(rng, "0123456789abcdef", rng.choice([32, 40, 64]))
    if kind == 1:
        return _of(rng, letters, rng.randint(20, 48))
    if kind == 2:
        return _of(rng, letters + "+/", rng.choice([40, 44]))
    if kind == 3:
        return rng.choice(["sk_live_", "pat_", "key-", "tok."]) + _of(rng, letters, rng.randint(20, 36))
    if kind == 4:
        return str(uuid.UUID(int=rng.getrandbits(128), version=4))
    if kind == 5:
        return _of(rng, letters, 2) + _of(rng, string.digits, 2) + _of(rng, letters + "!#$%*+-.", rng.randint(6, 14)) + rng.choice(string.digits)
    return _of(rng, string.ascii_uppercase + string.digits, rng.randint(16, 24))


#: fixed values: beginnings of issued tokens, the signs that follow and how many
ISSUED = (
    ("AKIA", string.ascii_uppercase + string.digits, 16), ("ASIA", string.ascii_uppercase + string.digits, 16), ("ghp_", string.ascii_letters + string.digits, 36), ("gho_", string.ascii_letters + string.digits, 36), ("glpat-", string.ascii_letters + string.digits + "_-", 20),
    ("sk_live_", string.ascii_letters + string.digits, 24), ("rk_live_", string.ascii_letters + string.digits, 24), ("npm_", string.ascii_letters + string.digits, 36), ("AIza", string.ascii_letters + string.digits + "_-", 35), ("hf_", string.ascii_letters, 34),
)


def _issued(rng: random.Random) -> str:
    part = lambda n: base64.urlsafe_b64encode(rng.randbytes(n)).decode().rstrip("=")
    kind = rng.randrange(len(ISSUED) + 4)
    if kind < 2:
        return "xoxb-" + "-".join([_of(rng, string.digits, 12), _of(rng, string.digits, 12), _of(rng, string.ascii_letters + string.digits, 24)])
    if kind < 4:
        claims = f'{{"sub":"{rng.randrange(10**9)}","name":"{_word(rng)}"}}'.encode()
        return ".".join([base64.urlsafe_b64encode(b'{"alg":"HS256"}').decode().rstrip("="), base64.urlsafe_b64encode(claims).decode().rstrip("="), part(32)])
    lead, signs, n = ISSUED[kind - 4]
    return lead + _of(rng, signs, n)


def labelled_findings(n: int = 12_000, seed: int = 5, forms: str = "all") -> list[tuple[int, str, int, int, int, str]]:
    """n rows of SCHEMA; forms "even" and "odd" have every other form only, so that one set can judge a model of the other."""
    pick = {"all": slice(None), "even": slice(0, None, 2), "odd": slice(1, None, 2)}[forms]
    rng = random.Random(seed)
    out = []
    for i in range(n):
        name = rng.choice(NAMES)
        if i % 2:
            form = rng.choice(["secret", "secret", "token", "block"])
            if form == "secret":
                shape, value = rng.choice(SECRET_FORMS[pick]), _secret(rng)
            elif form == "token":
                shape, value = rng.choice(TOKEN_FORMS[pick]), _issued(rng)
            else:
                body = base64.b64encode(rng.randbytes(48 * rng.randint(1, 4))).decode()
                shape, value = rng.choice(BLOCK_FORMS[pick]), "\n".join(body[k : k + 64] for k in range(0, len(body), 64))
        else:
            form, shape = rng.choice(OTHER_FORMS[pick])
            value = None
        filled = {
            "n": name, "N": name.upper(), "i": rng.choice(ISSUED)[0], "v": value, "num": str(rng.randrange(1000, 99999)), "d2": f"{rng.randrange(10, 28)}", "uuid": str(uuid.UUID(int=rng.getrandbits(128), version=4)), "word": _word(rng), "Word": _word(rng).title(),
            "alnum": _of(rng, string.ascii_lowercase + string.digits, 18), "b64": base64.b64encode(rng.randbytes(rng.choice([30, 48, 63]))).decode(), **{f"hex{k}": _of(rng, "0123456789abcdef", k) for k in (32, 40, 64)},
        }
        line = shape.format(**filled)
        before, after = (" ".join(_word(rng) for _ in range(rng.randint(0, 9))) for _ in range(2))
        lead = before + rng.choice([" ", "\n"]) if before else ""
        text = lead + line + (rng.choice([" ", "\n"]) + after if after else "")
        at, size = (len(lead) + line.rindex(value), len(value)) if value else (len(lead), len(line))
        out.append((i, text, at, size, int(value is not None), form))
    return out
