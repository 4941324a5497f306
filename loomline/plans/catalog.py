"""All named queries of the library, gathered from the modules of this folder."""

from __future__ import annotations

from loomline.plans import calculations, chats, corpora, curation, decisions, evaluation, relational, retrieval, scalars, storage, streams, texts  # noqa: F401
from loomline.plans.registry import ORACLES, QUERIES  # noqa: F401
