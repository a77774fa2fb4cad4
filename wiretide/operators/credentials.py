"""Credentials that a capture exposes, for those who must change them.

Rows come from both directions of TCP streams by patterns.  Secrets are shown as SHA-256 digests unless ``disclose`` is
set, which an incident's owner may need to tell one password from another account's.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .protocols import text

COLUMNS = ("capture_id", "protocol", "method", "username", "secret", "secret_kind", "client", "server", "server_port", "number", "ts", "crackable")


def _b64(value: Column) -> Column:
    return F.decode(F.try_to_binary(value, F.lit("base64")), "ISO-8859-1")


def exposed(streams: DataFrame, disclose: bool = False) -> DataFrame:
    """FTP, POP3, IMAP, SMTP, Telnet and HTTP log-ins of reassembled streams (``reassembly.streams``): each that a stream
    has, wherever it stands, once."""
    key = ["capture_id", "client", "client_port", "server", "server_port"]
    up, port_ = F.col("to_server"), F.col("server_port")
    # both directions in one pass; only Telnet's answers are read
    first = lambda c: F.max(F.when(up, c))
    s = streams.where(up | (port_ == 23)).groupBy(*key).agg(first(F.col("data")).alias("said"), F.max(F.when(~up, F.col("data"))).alias("answer"), first(F.col("number")).alias("number"), first(F.col("first_seen")).alias("ts"))
    s = s.where("said IS NOT NULL").withColumns({"said": text(F.col("said")), "answer": F.coalesce(text(F.col("answer")), F.lit(""))})
    said, answer = F.col("said"), F.col("answer")
    every = lambda p, g=1: F.regexp_extract_all(said, F.lit(p), g)
    port = lambda *p: F.col("server_port").isin(*p)
    part = lambda x, i: F.try_element_at(x, F.lit(i))

    def rows(where: Column, protocol: str, method: str, found: Column, of: Callable[[Column], tuple[Column, Column]], kind: str = "password", crackable: bool = False) -> Column:
        def one(x: Column) -> Column:
            user, secret = of(x)
            return F.struct(F.lit(protocol).alias("protocol"), F.lit(method).alias("method"), user.alias("username"), secret.alias("secret"), F.lit(kind).alias("secret_kind"), F.lit(crackable).alias("crackable"))

        return F.when(where, F.transform(found, one))

    pairs = lambda p: F.arrays_zip(every(p, 1).alias("a"), every(p, 2).alias("b"))
    both = lambda x: (x["a"], x["b"])
    plain = lambda x: (lambda c: (part(c, 2), part(c, 3)))(F.split(_b64(x), "\0"))
    cram = lambda x: (lambda c: (part(c, 1), part(c, 2)))(F.split(_b64(x), " "))
    basic = lambda x: (lambda c: (part(c, 1), part(c, 2)))(F.split(_b64(x), ":", 2))
    decoded = lambda x: tuple(F.coalesce(F.try_url_decode(x[k]), x[k]) for k in ("a", "b"))
    digest = lambda x: (F.regexp_extract(x, 'username="([^"]*)"', 1), F.nullif(F.regexp_extract(x, 'response="([0-9a-f]{32})"', 1), F.lit("")))
    user_pass = r"(?im)^USER ([^\r\n]+)\r?\n(?:(?!USER |PASS )[^\r\n]*\r?\n){0,8}PASS ([^\r\n]+)"
    # a terminal's keys, with what it asks kept out; backspaces would be part of the secret
    keys = F.split(F.regexp_replace(F.regexp_replace(said, "\xff[\xfb-\xfe].", ""), "\0", ""), r"\r\n?|\n")
    asked = port(23) & F.lower(answer).rlike("login:|password:") & (part(keys, 2) != "")
    http = said.rlike(r"^[A-Z]+ [^\r\n]+ HTTP/")
    found = [
        rows(port(21), "FTP", "USER/PASS", pairs(user_pass), both), rows(port(110), "POP3", "USER/PASS", pairs(user_pass), both),
        rows(port(110), "POP3", "APOP", pairs(r"(?im)^APOP (\S+) ([0-9a-f]{32})"), both, "hash", True),
        rows(port(143), "IMAP", "LOGIN", pairs(r'(?im)^\S+ LOGIN "?([^"\s]+)"? "?([^"\r\n]+?)"?\r?$'), both),
        rows(port(25, 587, 110, 143), "SMTP", "AUTH PLAIN", every(r"(?im)^(?:\S+ )?AUTH(?:ENTICATE)? PLAIN\s+([A-Za-z0-9+/=]+)"), plain),
        rows(port(25, 587), "SMTP", "AUTH LOGIN", pairs(r"(?is)AUTH LOGIN\r?\n([A-Za-z0-9+/=]+)\r?\n([A-Za-z0-9+/=]+)"), lambda x: (_b64(x["a"]), _b64(x["b"]))),
        rows(port(25, 587, 110, 143), "SMTP", "AUTH CRAM-MD5", every(r"(?is)AUTH CRAM-MD5\r?\n([A-Za-z0-9+/=]+)"), cram, "challenge-response", True),
        rows(asked, "Telnet", "login", F.array(F.struct(part(keys, 1).alias("a"), part(keys, 2).alias("b"))), both),
        rows(http, "HTTP", "HTTP Basic", every(r"(?im)^Authorization: Basic ([A-Za-z0-9+/=]+)"), basic),
        rows(http, "HTTP", "form", pairs(r"(?i)[?&\s](?:user(?:name)?|login|email)=([^&\s]+)&(?:[^\s]*?&)?pass(?:word|wd)?=([^&\s]+)"), decoded),
        rows(http, "HTTP", "HTTP Digest", every(r"(?im)^Authorization: Digest ([^\r\n]+)"), digest, "hash", True),
    ]
    none = F.array().cast("array<struct<protocol:string,method:string,username:string,secret:string,secret_kind:string,crackable:boolean>>")
    whole = F.array_distinct(F.filter(F.flatten(F.array(*[F.coalesce(x, none) for x in found])), lambda x: x["secret"].isNotNull()))
    out = s.withColumn("c", F.explode(whole)).select("capture_id", "client", "server", "server_port", "number", "ts", "c.*")
    if not disclose:
        out = out.withColumn("secret", F.sha2("secret", 256))
    return out.select(*COLUMNS)


def sip_digests(sip: DataFrame, disclose: bool = False) -> DataFrame:
    """SIP digest answers with the challenge that they answer (same call and nonce), which can be tried against word lists: user,
    realm, nonce, uri, algorithm, response (its SHA-256 unless ``disclose``), and the packet and station of the challenge, null if
    the capture hasn't got it."""
    of = lambda c, name: F.nullif(F.coalesce(F.nullif(F.regexp_extract(c, rf'(?i)(?:^|[,\s]){name}[ \t]*=[ \t]*"([^"]*)"', 1), F.lit("")), F.regexp_extract(c, rf"(?i)(?:^|[,\s]){name}[ \t]*=[ \t]*([^\s,\"]+)", 1)), F.lit("")).alias(name)
    names = ("username", "realm", "nonce", "uri", "response", "algorithm")
    told = lambda c: sip.where(F.col(c) != "").withColumn(c, F.struct(*[of(c, n) for n in names]))
    a = told("answer").where("answer.response IS NOT NULL").select(
        "capture_id", "call_id", "method", "number", "ts", F.col("src_ip").alias("client"), F.col("dst_ip").alias("server"), F.coalesce(F.nullif("dst_port", F.lit(0)), "src_port", F.lit(0)).alias("server_port"), "answer.username", "answer.realm", "answer.nonce", "answer.uri",
        F.coalesce("answer.algorithm", F.lit("MD5")).alias("algorithm"), F.col("answer.response").alias("secret"),
    )
    c = told("challenge").where("challenge.nonce IS NOT NULL").groupBy("capture_id", "call_id", F.col("challenge.nonce").alias("nonce")).agg(F.min_by(F.struct("number", "src_ip", "challenge.realm"), "number").alias("c"))
    out = a.join(c, ["capture_id", "call_id", "nonce"], "left").withColumns({"realm": F.coalesce("realm", "c.realm"), "challenged": F.col("c.number"), "challenger": F.col("c.src_ip")}).drop("c")
    return out if disclose else out.withColumn("secret", F.sha2("secret", 256))


def sip_exposed(sip: DataFrame, disclose: bool = False) -> DataFrame:
    """Each SIP digest answer as a credential."""
    d = sip_digests(sip, disclose).withColumns({"protocol": F.lit("SIP"), "secret_kind": F.lit("challenge-response"), "crackable": F.lit(True), "method": F.concat(F.lit("Digest ("), F.coalesce("method", F.lit("")), F.lit(")"))})
    return d.select(*COLUMNS)


def ntlm_exposed(ntlm: DataFrame) -> DataFrame:
    """NTLM answers, which can be tried against word lists; the answer itself isn't kept."""
    n = ntlm.where("message_type = 3 AND user <> ''")
    return n.select("capture_id", F.lit("NTLM").alias("protocol"), F.concat(F.lit("NTLM ("), F.coalesce("ntlm_version", F.lit("none")), F.lit(")")).alias("method"), F.concat_ws("\\", "domain", "user").alias("username"), F.lit(None).cast("string").alias("secret"), F.lit("challenge-response").alias("secret_kind"), F.col("src_ip").alias("client"), F.col("dst_ip").alias("server"), F.col("dst_port").alias("server_port"), "number", "ts", F.lit(True).alias("crackable"))
