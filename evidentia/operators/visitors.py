"""Visitor sessions, pseudonyms, and client addresses."""

from __future__ import annotations

import ipaddress
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F


def pseudonymize(c_value: Column, c_day: Column, secret: str) -> Column:
    """Short pseudonym that changes every day."""
    day = F.date_format(c_day, "yyyy-MM-dd")
    return F.substring(F.sha2(F.concat(c_value, day, F.lit(secret)), 256), 1, 16)


def token_hash(c_token: Column) -> Column:
    return F.sha2(c_token, 256)


def valid_visitors(tokens: DataFrame, visitors: DataFrame, as_of) -> DataFrame:
    """Visitors whose token was presented and still counts; ``last_seen_at`` moves at most hourly."""
    now = F.lit(as_of).cast("timestamp")
    presented = tokens.where(F.coalesce("token", F.lit("")) != "").select(token_hash(F.col("token")).alias("token_hash"))
    due = F.col("last_seen_at") <= now - F.expr("INTERVAL 1 HOUR")
    return (
        visitors.where(F.col("revoked_at").isNull() & (F.col("expires_at") > now))
        .join(presented, "token_hash", "left_semi")
        .withColumn("last_seen_at", F.when(due, now).otherwise(F.col("last_seen_at")))
    )


_OCTET = r"(25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
_IPV4 = rf"\A{_OCTET}\.{_OCTET}\.{_OCTET}\.{_OCTET}\z"


def ipv4_number(c: Column) -> Column:
    """IPv4 address as a number, null if ``c`` is not one."""
    number = F.lit(0).cast("long")
    for group in range(1, 5):
        number = number * 256 + F.try_to_number(F.regexp_extract(c, _IPV4, group), F.lit("999")).cast("long")
    return F.when(F.rlike(c, F.lit(_IPV4)), number)


def resolve_client_ip(requests: DataFrame, trusted: Sequence[str], ipv6: bool = False) -> DataFrame:
    """Adds ``client_ip``: the forwarded address if the peer is a trusted proxy, else the peer.

    Trusted networks are configuration: each is one range test in the expression,
    so no join is needed. With ``ipv6`` a vectorised Python function handles
    addresses that contain a colon.
    """
    networks = [ipaddress.ip_network(t, strict=False) for t in trusted]
    peer = ipv4_number(F.col("peer"))
    inside = F.lit(False)
    for net in networks:
        if net.version == 4:
            inside = inside | peer.between(int(net.network_address), int(net.broadcast_address))
    forwarded = F.trim(F.coalesce("forwarded", F.lit("")))
    trusted_peer = F.coalesce(inside, F.lit(False))
    address = F.when(F.rlike(forwarded, F.lit(_IPV4)), forwarded)
    if ipv6:
        wide = [str(n) for n in networks if n.version == 6]

        @F.pandas_udf("boolean")
        def in_wide(values: pd.Series) -> pd.Series:
            nets = [ipaddress.ip_network(w) for w in wide]
            return values.map(lambda v: any(a in n for n in nets) if (a := _parse(v)) else False)

        @F.pandas_udf("string")
        def canonical(values: pd.Series) -> pd.Series:
            return values.map(lambda v: str(a) if (a := _parse(v)) else None)

        trusted_peer = trusted_peer | in_wide(F.col("peer"))
        address = F.coalesce(address, canonical(forwarded))
    return requests.withColumn("client_ip", F.coalesce(F.when(trusted_peer, address), F.col("peer")))


def _parse(value):
    try:
        return ipaddress.ip_address(value)
    except ValueError:
        return None
