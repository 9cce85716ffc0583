"""Leases: one holder at a time, with a token that rises from holder to holder."""

from __future__ import annotations

import hashlib
import re
import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import SparkSession

from ..errors import ValidationError
from ..functions.checks import NUL, RESOURCE_ID, SCOPE
from .manifests import Folder


@dataclass(frozen=True)
class Lease:
    """What a holder has: the token is above that of every earlier holder."""

    root: str
    name: str
    holder: str
    token: int
    expires: float


def newest(spark: SparkSession, root: str, name: str) -> int:
    """The newest token of a lease, 0 if nobody ever held it."""
    return (Folder(spark, f"{root}/leases/{name}").numbers() or [0])[-1]


def acquire(spark: SparkSession, root: str, name: str, holder: str, seconds: float, clock: Callable[[], float] = time.time) -> Lease | None:
    """The lease, or None while another holder has it.

    It is free if nobody has held it, if its time is over or if it was released; the same holder gets it anew, with a new
    token, at any time. Of two who try at once one gets it. Clocks may disagree: what a late holder still writes is
    refused by its token, not by its clock.
    """
    if not name or "/" in name or name.startswith(".") or not holder or seconds <= 0:
        raise ValidationError("a lease has a name, a holder and some time", name=name, holder=holder)
    folder = Folder(spark, f"{root}/leases/{name}")
    token = (folder.numbers() or [0])[-1]
    if token:
        last = folder.read(token)
        if last["holder"] not in ("", holder) and last["expires"] > clock():
            return None
    lease = Lease(root, name, holder, token + 1, clock() + seconds)
    return lease if folder.create(token + 1, {"holder": holder, "expires": lease.expires}) else None


def release(spark: SparkSession, lease: Lease) -> bool:
    """Free the lease before its time, unless it has gone to another holder."""
    return newest(spark, lease.root, lease.name) == lease.token and Folder(spark, f"{lease.root}/leases/{lease.name}").create(lease.token + 1, {"holder": "", "expires": 0.0})


def flight_name(tenant: str, endpoint_alias: str, batch_id: str) -> str:
    """A name that no other job has. What isn't a tenant, an alias as it is stored, and a batch id is an error that doesn't repeat it."""
    fields = (tenant, endpoint_alias, batch_id)
    fine = all(type(f) is str for f in fields) and re.fullmatch(SCOPE.strip("^").removesuffix(r"\z"), tenant) and re.fullmatch(RESOURCE_ID.strip("^").removesuffix(r"\z"), batch_id)
    if not fine or endpoint_alias != endpoint_alias.strip() or not 1 <= len(endpoint_alias) <= 128 or NUL in endpoint_alias:
        raise ValidationError("the job's identity is not valid")
    raw = [f.encode("utf-8", "surrogatepass") for f in fields]
    return "job-" + hashlib.sha256(b"".join(len(r).to_bytes(8, "big") + r for r in raw)).hexdigest()


def single_flight(spark: SparkSession, root: str, tenant: str, endpoint_alias: str, batch_id: str, holder: str, seconds: float) -> Lease | None:
    """The lease of one job's reconciliation. Its identity is checked, and its name is a digest that no other identity has."""
    return acquire(spark, root, flight_name(tenant, endpoint_alias, batch_id), holder, seconds)
