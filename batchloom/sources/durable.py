"""Provider calls whose outcome is remembered: an order number is reserved before each call, an observation kept after it."""

from __future__ import annotations

import datetime as dt
import json
from collections.abc import Callable
from typing import Any

from ..errors import GatewayError
from .provider import Provider

Observation = dict[str, Any]


def observation(tenant: str, endpoint_alias: str, order: int, answer: dict[str, Any], at: dt.datetime) -> Observation:
    """A provider's answer about a batch as a raw observation, for lifecycle.normalized."""
    counts = answer.get("request_counts") if isinstance(answer.get("request_counts"), dict) else {}
    text = lambda v: None if v is None else v if isinstance(v, str) else json.dumps(v)
    return {
        "tenant_scope": tenant, "endpoint_alias": endpoint_alias, "remote_batch_id": text(answer.get("id")), "observation_order": order, "arrival": order, "input_file_id": text(answer.get("input_file_id")),
        "endpoint": text(answer.get("endpoint")), "status": text(answer.get("status")), "output_file_id": text(answer.get("output_file_id")), "error_file_id": text(answer.get("error_file_id")),
        "total": text(counts.get("total")), "completed": text(counts.get("completed")), "failed": text(counts.get("failed")), "metadata": text(answer.get("metadata")), "observed_at": at,
    }


class DurableProvider:
    """Create, poll and cancel. `reserve` gives the next order number, `record` keeps an observation."""

    def __init__(self, provider: Provider, tenant: str, endpoint_alias: str, reserve: Callable[[], int], record: Callable[[Observation], None], now: Callable[[], dt.datetime] = lambda: dt.datetime.now(dt.UTC)) -> None:
        self.provider, self.tenant, self.alias, self.reserve, self.record, self.now = provider, tenant, endpoint_alias, reserve, record, now

    def _call(self, f: Callable[[], dict[str, Any]], batch_id: str | None = None) -> dict[str, Any]:
        order = self.reserve()
        answer = f()
        self._keep(order, answer, batch_id)
        return answer

    def _keep(self, order: int, answer: dict[str, Any], batch_id: str | None) -> None:
        if batch_id is not None and answer.get("id") != batch_id:
            raise GatewayError("the answer is about another batch", batch=batch_id)
        self.record(observation(self.tenant, self.alias, order, answer, self.now()))

    def create(self, input_file_id: str, endpoint: str, metadata: dict[str, str] | None = None) -> dict[str, Any]:
        return self._call(lambda: self.provider.create(input_file_id, endpoint, metadata))

    def status(self, batch_id: str) -> dict[str, Any]:
        return self._call(lambda: self.provider.status(batch_id), batch_id)

    def cancel(self, batch_id: str) -> dict[str, Any]:
        """The order is reserved before the call, so that no later poll gets a lower one; a refusal is no observation."""
        order = self.reserve()
        answer = self.provider.cancel(batch_id)
        if answer.get("cancelled") is not False:
            self._keep(order, answer, batch_id)
        return answer
