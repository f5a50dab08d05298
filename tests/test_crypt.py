from __future__ import annotations

from hashlib import md5, sha256

import numpy as np
import pytest
from pyspark.sql import functions as F

from quire import engine
from quire.operators import crypt, documents, pdf

GREY = np.where(np.arange(60).reshape(6, 10) % 7 < 3, 0, 255).astype(np.uint8)
ID = bytes(range(16))


def test_published_vectors():
    plain = bytes.fromhex("00112233445566778899aabbccddeeff")
    for key, sealed in ((bytes(range(16)), "69c4e0d86a7b0430d8cdb78070b4c55a"), (bytes(range(32)), "8ea2b7ca516745bfeafc49904b496089")):
        assert crypt.aes_encrypt(key, plain, bytes(16)).hex() == sealed
        assert crypt.aes_decrypt(key, bytes.fromhex(sealed), bytes(16)) == plain
    assert crypt.rc4(b"Key", b"Plaintext").hex() == "bbf316e8d940af0ad3" and crypt.rc4(b"Wiki", b"pedia").hex() == "1021bf0420"


def pad16(data):
    n = 16 - len(data) % 16
    return data + bytes([n]) * n


def protected(version: int, revision: int, user: str = "open", owner: str = "master", metadata: bool = True) -> bytes:
    """A file that is enciphered as the rules say, written independently of the reader's path."""
    doc = pdf.load(pdf.save(pdf.new_document([(20, 10, pdf.image_stream(GREY), b"BT (hello) Tj ET")])))
    doc.trailer["Info"] = doc.add({"Title": b"a title"})
    entries = {"Filter": pdf.Name("Standard"), "V": version, "R": revision, "P": -44}
    if version >= 4:
        method = {4: "AESV2", 5: "AESV3"}[version]
        entries |= {"CF": {"StdCF": {"CFM": pdf.Name(method), "AuthEvent": pdf.Name("DocOpen")}}, "StmF": pdf.Name("StdCF"), "StrF": pdf.Name("StdCF"), "EncryptMetadata": metadata}
    if version == 5:
        key, sha = bytes(range(32)), (lambda p, s, u=b"": sha256(p + s + u).digest()) if revision == 5 else crypt.hardened
        u = sha(user.encode(), b"validate") + b"validate" + b"keysalt1"
        entries |= {"U": u, "UE": crypt.aes_encrypt(sha(user.encode(), b"keysalt1"), key, bytes(16))}
        entries |= {"O": sha(owner.encode(), b"valid..2", u) + b"valid..2" + b"keysalt2", "OE": crypt.aes_encrypt(sha(owner.encode(), b"keysalt2", u), key, bytes(16))}
    else:
        n = 5 if version == 1 else 16
        entries |= {"Length": 8 * n}
        sealed = (user.encode() + crypt.PAD)[:32]
        for i in range(20 if revision >= 3 else 1):
            sealed = crypt.rc4(bytes(b ^ i for b in crypt.owner_key(owner.encode(), revision, n)), sealed)
        entries["O"] = sealed
        key = crypt._file_key(user.encode(), entries, ID, n)
        entries["U"] = crypt.user_entry(key, revision, ID).ljust(32, b"\0")

    def sealed_bytes(data: bytes, number: int) -> bytes:
        own = key if version == 5 else md5(key + number.to_bytes(3, "little") + b"\0\0" + (b"sAlT" if version == 4 else b"")).digest()[: min(len(key) + 5, 16)]
        if version < 4:
            return crypt.rc4(own, data)
        return bytes(range(16)) + crypt.aes_encrypt(own, pad16(data), bytes(range(16)))

    def sealed_object(x, number: int):
        if type(x) is bytes:
            return sealed_bytes(x, number)
        if isinstance(x, list):
            return [sealed_object(y, number) for y in x]
        if isinstance(x, dict):
            return {k: sealed_object(v, number) for k, v in x.items()}
        if isinstance(x, pdf.Stream):
            return pdf.Stream(sealed_object(x.entries, number), sealed_bytes(x.data, number))
        return x

    doc.objects = {n: sealed_object(x, n) for n, x in doc.objects.items()}
    ref = doc.add(entries)
    out = pdf.save(doc)
    return out.replace(b"trailer\n<<", b"trailer\n<</Encrypt %d 0 R /ID [<%s> <%s>] " % (ref.number, ID.hex().encode(), ID.hex().encode()))


KINDS = [(1, 2), (2, 3), (4, 4), (5, 5), (5, 6)]


@pytest.mark.parametrize(("version", "revision"), KINDS)
def test_files_open_with_either_password(monkeypatch, version, revision):
    monkeypatch.setattr(pdf, "_compressed", lambda x: x)  # else streams would be compressed after they were enciphered
    data = protected(version, revision)
    for password in ("open", "master"):
        doc = pdf.load(data, password)
        page, _, resources = doc.pages()[0]
        assert doc.content(page) == b"BT (hello) Tj ET" and not doc.encrypted
        assert doc.get(doc.trailer["Info"])["Title"] == b"a title"
        assert (pdf.pixels(doc, pdf.images(doc, resources)[0][2]) == GREY).all()
    with pytest.raises(pdf.PasswordError, match="password may be incorrect"):
        pdf.load(data, "wrong")
    with pytest.raises(pdf.PasswordError, match="password required"):
        pdf.load(data)


def test_a_job_with_its_password(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(pdf, "_compressed", lambda x: x)
    (tmp_path / "in.pdf").write_bytes(protected(4, 4))
    monkeypatch.undo()
    (tmp_path / "out").mkdir()
    e = engine.Engine(spark, f"{tmp_path}/engine")
    assert e.check_file_encrypted(f"{tmp_path}/in.pdf")
    for password, status, reason in (("open", "completed", None), ("wrong", "failed", "password may be incorrect"), (None, "failed", "password required")):
        e.enqueue([f"{tmp_path}/in.pdf"], f"{tmp_path}/out", {"compression": "ccitt", "password": password})
        e.start_queue(engine.clean_documents)
        job = e.get_status().orderBy(F.desc("seq")).first()
        assert (job.status, job.error_message) == (status, reason) and not e.passwords
    doc = pdf.load((tmp_path / "out/in_cleaned.pdf").read_bytes())
    assert not doc.encrypted and len(doc.pages()) == 1
    rows = documents.document_images(spark.createDataFrame([("x", bytearray(protected_plain(tmp_path)), None)], "path string, content binary, password string")).collect()
    assert [(r.page_number, r.name, r.width, r.height, r.error) for r in rows] == [(1, "Im0", 10, 6, None)]


def protected_plain(tmp_path) -> bytes:
    return (tmp_path / "out/in_cleaned.pdf").read_bytes()
