"""Profiles, model settings and graph bindings: small closed files, read where the driver runs."""

from __future__ import annotations

import json
import tomllib
from urllib.parse import urlsplit

#: Actions of a pseudonymisation rule, and what a pseudonym's scope may be.
ACTIONS, SCOPES = ("keep", "remove", "coarsen", "pseudonym"), ("local", "corpus")


def closed(found: dict, required: set[str], optional: set[str] = frozenset()) -> list[str]:
    """What keys are missing or unknown."""
    return [f"missing: {k}" for k in sorted(required - set(found))] + [f"unknown: {k}" for k in sorted(set(found) - required - set(optional))]


def load_profile(text: str) -> dict:
    """A profile: id, record_prefix, record_digits, production, pseudonymisation_required, and optional pii_detection
    and rules by entity type. Anything else raises ValueError with all problems."""
    found = tomllib.loads(text)
    problems = closed(found, {"id", "record_prefix", "record_digits", "production", "pseudonymisation_required"}, {"pii_detection", "rules"})
    for name, kind in (("id", str), ("record_prefix", str), ("record_digits", int), ("production", bool), ("pseudonymisation_required", bool)):
        if name in found and type(found[name]) is not kind:  # a boolean is no number
            problems.append(f"type: {name}")
    if found.get("pseudonymisation_required") is True and found.get("pii_detection") not in ("manual", "model"):
        problems.append("value: pii_detection")
    for entity, rule in found.get("rules", {}).items():
        action = rule.get("action")
        need = {"coarsen": {"action", "value"}, "pseudonym": {"action", "scope"}}.get(action, {"action"})
        problems += [f"{entity}: {p}" for p in closed(rule, need)]
        if action not in ACTIONS or action == "pseudonym" and rule.get("scope") not in SCOPES:
            problems.append(f"{entity}: value: action")
    if problems:
        raise ValueError("; ".join(problems))
    return found


def policy(profile: dict) -> dict[str, tuple[str, str | None]]:
    """The rules of a profile as ``mentions.entries`` takes them."""
    return {entity: (rule["action"], rule.get("value")) for entity, rule in profile.get("rules", {}).items()}


def load_model(text: str) -> dict:
    """Settings of a local model: host (loopback only), model, model_digest, temperature, seed, num_ctx, num_predict, timeout."""
    found = tomllib.loads(text)
    problems = closed(found, {"host", "model", "model_digest", "temperature", "seed", "num_ctx", "num_predict", "timeout"})
    host = urlsplit(str(found.get("host", "")))
    if host.scheme != "http" or host.hostname not in ("127.0.0.1", "::1", "localhost") or host.path not in ("", "/") or host.username:
        problems.append("value: host")
    problems += [f"type: {k}" for k in ("seed", "num_ctx", "num_predict", "timeout") if k in found and (type(found[k]) is not int or found[k] < 0)]
    if problems:
        raise ValueError("; ".join(problems))
    return found


def load_binding(text: str, profile_id: str, fingerprint: str) -> str:
    """bound, moved (another graph of the profile) or foreign (another profile) for a graph binding file of exactly three
    fields; more than 64 KiB, other fields, repeated keys or no JSON raise ValueError."""
    if len(text.encode()) > 64 * 1024:
        raise ValueError("too large")

    def once(pairs):
        if len({k for k, _ in pairs}) != len(pairs):
            raise ValueError("repeated key")
        return dict(pairs)

    found = json.loads(text, object_pairs_hook=once)
    if not isinstance(found, dict) or set(found) != {"v", "profile_id", "graph_sha256"} or type(found["v"]) is not int or found["v"] != 1:
        raise ValueError("not a binding")
    if found["profile_id"] != profile_id:
        return "foreign"
    return "bound" if found["graph_sha256"] == fingerprint else "moved"
