"""Kubernetes resources: which kinds to read, where their API is, and a planner that may ask a language model."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator, Sequence
from datetime import UTC, datetime
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from lodestone.sources import scan
from lodestone.sources.registry import Ref
from lodestone.sources.rest import Get, bearer, checked, http_get

#: API groups by kind (fixed values); other kinds are in the core group.
GROUPS = {
    "apps/v1": ["Deployment", "StatefulSet", "DaemonSet", "ReplicaSet"],
    "batch/v1": ["Job", "CronJob"],
    "networking.k8s.io/v1": ["Ingress", "NetworkPolicy"],
    "rbac.authorization.k8s.io/v1": ["Role", "RoleBinding", "ClusterRole", "ClusterRoleBinding"],
    "autoscaling/v2": ["HorizontalPodAutoscaler"],
}
CORE = ["Pod", "Service", "ConfigMap", "Secret", "ServiceAccount", "PersistentVolumeClaim", "PersistentVolume", "Namespace", "Node"]
CLUSTER_SCOPED = ["ClusterRole", "ClusterRoleBinding", "PersistentVolume", "Namespace", "Node"]
PLURALS = {"Ingress": "ingresses", "NetworkPolicy": "networkpolicies"}
ALWAYS_EXCLUDED = ["Secret", "Event"]
MAX_ITERATIONS = 3
#: Resources that one answer lists.
PAGE = 500

LanguageModel = Callable[[str], str]


def plural(kind: str) -> str:
    return PLURALS.get(kind) or kind.lower() + ("es" if kind.endswith("s") else "s")


def api_path(kind: str, namespace: str | None = None) -> str:
    group = next((g for g, kinds in GROUPS.items() if kind in kinds), None)
    root = f"/apis/{group}" if group else "/api/v1"
    return f"{root}/{plural(kind)}" if kind in CLUSTER_SCOPED or not namespace else f"{root}/namespaces/{namespace}/{plural(kind)}"


def parse_kinds(answer: str) -> list[str]:
    """The JSON list in a model's answer, with or without a code fence; anything else is empty."""
    bare = re.sub(r"^\s*```(?:json)?\s*|\s*```\s*$", "", answer.strip())
    try:
        found = json.loads(bare)
    except ValueError:
        return []
    return [x for x in found if isinstance(x, str)] if isinstance(found, list) else []


def select_kinds(include: Sequence[str], excluded: Sequence[str] = (), suggested: Sequence[str] = ()) -> list[str]:
    return sorted(set(include) - set(excluded) - set(suggested) - set(ALWAYS_EXCLUDED))


def discover_with(model: LanguageModel | None, prompt: str, parse: Callable[[str], list], default: Callable[[], list], attempts: int = MAX_ITERATIONS) -> list:
    """The first answer that parses to something; the deterministic default without a model or after all attempts."""
    for _ in range(attempts if model else 0):
        try:
            if found := parse(model(prompt)):
                return found
        except (ValueError, KeyError, OSError):
            continue
    return default()


def ollama(url: str, name: str, get: Callable[[str, dict], dict]) -> LanguageModel:
    def ask(prompt: str) -> str:
        answer = get(f"{url}/api/generate", {"model": name, "prompt": prompt, "stream": False})
        if "response" not in answer:
            raise ValueError("the answer has no response")
        return answer["response"]

    return ask


class KubernetesConnector:
    def __init__(self, config: dict[str, Any], secrets: dict[str, str], get: Get = http_get, model: LanguageModel | None = None):
        self.config = checked(config, {"base_url": str, "kinds": list, "exclude_kinds": list, "namespaces": list})
        self.get, self.model, self.headers = get, model, bearer(secrets, "token")

    def validate(self, spark: SparkSession) -> None:
        self.get(self.config["base_url"] + "/version", {}, self.headers)

    def kinds(self) -> list[str]:
        every = self.config.get("kinds") or [*CORE, *(k for kinds in GROUPS.values() for k in kinds)]
        skip = discover_with(self.model, f"Which of these kinds hold no documentation? Answer with a JSON list: {every}", parse_kinds, list)
        return select_kinds(every, self.config.get("exclude_kinds") or (), skip)

    def _items(self, path: str):
        """The resources of a list, page by page."""
        token = None
        while True:
            page = self.get(self.config["base_url"] + path, {"limit": PAGE, "continue": token} if token else {"limit": PAGE}, self.headers)
            yield from page.get("items") or []
            token = (page.get("metadata") or {}).get("continue")
            if not token:
                return

    def now(self) -> datetime:
        return datetime.now(UTC)

    def slices(self) -> list[str]:
        """Each kind in each namespace, ``kind/namespace``; without namespaces, or for cluster-wide kinds, ``kind/``."""
        spaces = self.config.get("namespaces") or [""]
        return [f"{kind}/{space}" for kind in self.kinds() for space in ([""] if kind in CLUSTER_SCOPED else spaces)]

    def listed(self, slice: str, since: datetime | None = None, until: datetime | None = None) -> Iterator[Ref]:
        """Resources of a kind; lists have no times of change, so ``since`` and ``until`` are the scan's to refuse."""
        kind, _, space = slice.partition("/")
        for item in self._items(api_path(kind, space or None)):
            m = item.get("metadata") or {}
            name = f"{kind}/{m.get('namespace') or 'cluster'}/{m.get('name')}"
            yield Ref(name, f"k8s://{name}", None, {"version": m.get("resourceVersion"), "kind": kind})

    def discover(self, spark: SparkSession) -> DataFrame:
        """All refs (REF), each kind of a namespace listed by a task."""
        return scan.read(spark, self).drop("slice")

    def fetch(self, spark: SparkSession, refs: DataFrame) -> DataFrame:
        """Each resource as YAML, read by tasks; managed fields and the last applied configuration are left out. One that is
        gone in the meantime has no row."""
        base, get, headers = self.config["base_url"], self.get, self.headers

        def run(batches):
            import pandas as pd
            import yaml

            for batch in batches:
                rows = []
                for r in batch.itertuples():
                    kind, space, name = r.external_id.split("/", 2)
                    item = get(f"{base}{api_path(kind, None if space == 'cluster' else space)}/{name}", {}, headers)
                    if not item or not item.get("metadata"):
                        continue
                    meta = item["metadata"]
                    meta.pop("managedFields", None)
                    (meta.get("annotations") or {}).pop("kubectl.kubernetes.io/last-applied-configuration", None)
                    item.setdefault("kind", kind)
                    rows.append((r.external_id, r.uri, "application/x-kubernetes", yaml.safe_dump(item, sort_keys=True).encode()))
                yield pd.DataFrame(rows, columns=["external_id", "uri", "content_type", "content"])

        return refs.select("external_id", "uri").mapInPandas(run, "external_id string, uri string, content_type string, content binary")
