"""Signatures of commits and tags against a table of keys.

An object's signature is taken apart from what it signs, its key is looked up
by fingerprint (a plain join, so hot keys are split by Spark), and the
signature is verified with that key only.
"""

from __future__ import annotations

import base64

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SIGNED = "id string, kind string, fingerprint string, signature binary, signed binary"


def _armored(text: str) -> tuple[str, bytes] | None:
    from ..functions.binary import armor_decode

    found = armor_decode(text + "\n")
    return (found["kind"], found["data"]) if found else None


def taken_apart(kind: str, body: bytes) -> tuple[str, str | None, bytes, bytes] | None:
    """(ssh or pgp, fingerprint of the key that it names, signature, what is signed) of a signed commit or tag."""
    from ..functions import crypto as C
    from ..sources.formats import signed_portion

    if kind == "commit":
        head = body.partition(b"\n\n")[0].decode("utf-8", "replace")
        lines, inside = [], False
        for line in head.split("\n"):
            if line.startswith("gpgsig"):
                inside = True
                lines.append(line.split(" ", 1)[1])
            elif inside and line.startswith(" "):
                lines.append(line[1:])
            else:
                inside = False
        found, signed = _armored("\n".join(lines)) if lines else None, signed_portion(body)
    else:
        marks = [at for at in (body.find(b"-----BEGIN SSH SIGNATURE-----"), body.find(b"-----BEGIN PGP SIGNATURE-----")) if at >= 0]
        found = _armored(body[min(marks) :].decode("utf-8", "replace")) if marks else None
        signed = body[: min(marks)] if marks else b""
    if not found:
        return None
    name, data = found
    try:
        if name == "SSH SIGNATURE":
            return "ssh", fingerprint_of(C.ssh_signature(data)["key"]), data, signed
        packet = next(b for t, b in C.pgp_packets(data) if t == 2)
        own = C.pgp_signature(packet)
        return "pgp", own.get("fingerprint") or own["issuer"], packet, signed
    except (ValueError, KeyError, IndexError, StopIteration):
        return None


def fingerprint_of(blob: bytes) -> str:
    """Fingerprint of a public key in its binary SSH form."""
    import hashlib

    return base64.b64encode(hashlib.sha256(blob).digest()).decode().rstrip("=")


def signatures(objects: DataFrame) -> DataFrame:
    """(id, type, content) of commits and tags -> id, kind, fingerprint, signature, signed of those that are signed."""

    def run(batches):
        import pyarrow as pa

        for b in batches:
            found = [(i, taken_apart(t, bytes(c))) for i, t, c in zip(*(b.column(k).to_pylist() for k in range(3)), strict=True)]
            rows = [(i, *x) for i, x in found if x]
            cols = list(zip(*rows, strict=True)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.string(), pa.string(), pa.string(), pa.binary(), pa.binary()), strict=True)], names=["id", "kind", "fingerprint", "signature", "signed"])

    return objects.filter("type IN ('commit', 'tag')").select("id", "type", "content").mapInArrow(run, SIGNED)


def verified(objects: DataFrame, keys: DataFrame) -> DataFrame:
    """(id, type, content), (fingerprint, principal, key) -> id, principal, valid.

    ``key`` is the binary SSH form or the body of an OpenPGP public key packet; a
    key is also found by the last 16 digits of its fingerprint.  Without a key
    the principal is null and the signature not valid.
    """
    rows = signatures(objects)
    short = keys.withColumn("short", F.substring("fingerprint", -16, 16))
    on = F.substring("s.fingerprint", -16, 16) == F.col("k.short")
    joined = rows.alias("s").join(short.alias("k"), on, "left").select("s.id", "s.kind", "s.signature", "s.signed", "k.principal", "k.key")

    def run(batches):
        import pyarrow as pa

        from ..functions import crypto as C

        for b in batches:
            ok = []
            for kind, signature, signed, key in zip(*(b.column(k).to_pylist() for k in (1, 2, 3, 5)), strict=True):
                try:
                    if key is None:
                        ok.append(False)
                    elif kind == "ssh":
                        ok.append(C.ssh_signature(signature)["key"] == key and C.verify_ssh(signature, signed))
                    else:
                        ok.append(C.verify_pgp(C.pgp_signature(signature), C.pgp_key(key), signed))
                except (ValueError, KeyError, IndexError):
                    ok.append(False)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(4), pa.array(ok, pa.bool_())], names=["id", "principal", "valid"])

    return joined.mapInArrow(run, "id string, principal string, valid boolean")

