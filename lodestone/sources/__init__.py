"""Connectors: discovering and fetching documents of outside systems as DataFrames.

``discover`` gives refs (external_id, uri, updated_at, metadata); ``fetch`` adds content_type and content. Ids are stable
natural keys, with the version in the metadata, so that an edit updates its document.
"""

from lodestone.sources import database, files, git, kubernetes, rest
from lodestone.sources.registry import Registry

REGISTRY = Registry()
for kind, connector in {
    "fs": files.FileConnector, "git": git.GitConnector, "confluence": rest.Confluence, "notion": rest.Notion,
    "slack": rest.Slack, "jira": rest.Jira, "database": database.DatabaseConnector, "k8s": kubernetes.KubernetesConnector,
}.items():
    REGISTRY.register(kind, connector)
