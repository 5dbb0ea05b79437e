"""Permanent removal of quarantined files: batches are prepared, confirmed, checked whole, then carried out one by one."""

from __future__ import annotations

import hashlib
import hmac
import os
import time
from collections.abc import Callable

from echofold.errors import InvalidInput, SafetyError, StateError
from echofold.operators import effect
from echofold.operators.ledger import BATCH_STEPS, ITEM_STEPS, Ledger

TTL_SECONDS = 600
_BATCH = frozenset(("batch:" + a, "batch:" + b) for a, b in BATCH_STEPS)
STEPS = ITEM_STEPS | frozenset({("planned", "cancelled")}) | _BATCH


def selection(entries: list[dict]) -> str:
    """A digest of what was chosen, whatever the order."""
    return hashlib.sha256("\n".join(sorted(f"{e['entry']}\0{e['destination']}\0{e['size_bytes']}\0{e['sha256']}" for e in entries)).encode()).hexdigest()


def phrase(entries: list[dict], immediate: bool) -> str:
    return f"DELETE {len(entries)} FILES {sum(e['size_bytes'] for e in entries)} BYTES{' NOW' if immediate else ''}"


def prepare(book: Ledger, entries: list[dict], now_ns: int | None = None, immediate: bool = False, ttl: int = TTL_SECONDS) -> dict:
    """A batch of entries (entry, project, destination, size_bytes, sha256, state, delete_state, retain_until_ns) and the phrase that confirms it.

    Entries must be verified, not being removed, of one project, each chosen once, and over their retention unless immediate.
    """
    now_ns = time.time_ns() if now_ns is None else now_ns
    if not entries or ttl <= 0:
        raise InvalidInput("a batch needs entries and a time to live")
    if len({e["entry"] for e in entries}) != len(entries) or len({e["project"] for e in entries}) != 1:
        raise InvalidInput("entries are of one project, each once")
    for e in entries:
        if e["state"] != "verified" or e["delete_state"] != "active" or e["size_bytes"] < 0:
            raise StateError(f"{e['entry']} can't be removed")
        if not immediate and e["retain_until_ns"] > now_ns:
            raise SafetyError(f"{e['entry']} is still to be kept")
    entries = sorted(entries, key=lambda e: str(e["entry"]))
    batch = {"phrase": phrase(entries, immediate), "selection": selection(entries), "project": entries[0]["project"], "immediate": immediate, "expires_ns": now_ns + ttl * 10**9, "items": entries}
    batch["token"] = hashlib.sha256(os.urandom(32)).hexdigest()
    batch["batch"] = f"batch-{batch['token'][:16]}"
    book.append(batch["batch"], "batch:prepared", **{k: v for k, v in batch.items() if k not in ("batch", "token")}, token_digest=hashlib.sha256(batch["token"].encode()).hexdigest())
    for k, e in enumerate(entries):
        book.append(f"{batch['batch']}:{k}", "planned", item=e)
    return batch


def violations(batch: dict) -> list[str]:
    """What a stored batch no longer agrees with: its own totals, or a file with what was proven of it."""
    items, out = batch["items"], []
    if batch["selection"] != selection(items) or batch["phrase"] != phrase(items, batch["immediate"]) or {e["project"] for e in items} != {batch["project"]}:
        out.append("the batch was changed")
    for e in items:
        try:
            effect.verify(e["destination"], e["size_bytes"], e["sha256"], "the file", e.get("blake3"), e.get("identity"))
            if os.stat(e["destination"]).st_nlink != 1:
                out.append(f"{e['entry']} has another name")
        except SafetyError as bad:
            out.append(str(bad))
    return out


def execute(book: Ledger, batch: dict, token: str, typed: str, now_ns: int | None = None, delete: Callable[[str], None] = os.unlink, stored: dict | None = None) -> dict:
    """Removes the files of a prepared batch. Nothing is removed unless every file is as it was proven; the first failure stops it.

    A file that is missing counts as removed only if its removal had begun before, which the ledger says.
    """
    now_ns, name = time.time_ns() if now_ns is None else now_ns, batch["batch"]
    wanted = (stored or batch).get("token_digest", hashlib.sha256(batch.get("token", "").encode()).hexdigest())
    if not hmac.compare_digest(hashlib.sha256(token.encode()).hexdigest(), wanted) or typed != batch["phrase"]:
        raise InvalidInput("the token or the phrase is not the batch's")
    state = book.states.get(name)
    if state not in ("batch:prepared", "batch:recovery_required"):
        raise StateError(f"the batch is {state}")
    if state == "batch:prepared" and now_ns > batch["expires_ns"]:
        book.append(name, "batch:expired")
        raise StateError("the batch has expired")
    begun = {k for k in range(len(batch["items"])) if book.states[f"{name}:{k}"] in ("deleting", "failed")}
    gone = {k for k in range(len(batch["items"])) if book.states[f"{name}:{k}"] == "deleted"}
    left = [e for k, e in enumerate(batch["items"]) if k not in gone and not (k in begun and not os.path.lexists(e["destination"]))]
    wrong = violations({**batch, "items": batch["items"]}) if not gone and not begun else [x for e in left for x in violations({**batch, "items": [e], "selection": selection([e]), "phrase": phrase([e], batch["immediate"])})]
    book.append(name, "batch:executing")
    if wrong:
        book.append(name, "batch:recovery_required", error=wrong[0])
        raise SafetyError(wrong[0])
    for k, e in enumerate(batch["items"]):
        item = f"{name}:{k}"
        if k in gone:
            continue
        if book.states[item] != "deleting":
            book.append(item, "deleting")
        try:
            if os.path.lexists(e["destination"]):
                delete(e["destination"])
        except OSError as bad:
            book.append(item, "failed", error=str(bad))
            book.append(name, "batch:recovery_required", error=str(bad))
            raise SafetyError(f"{e['entry']} couldn't be removed") from bad
        book.append(item, "deleted")
    book.append(name, "batch:completed")
    return {"deleted": len(batch["items"]), "bytes": sum(e["size_bytes"] for e in batch["items"])}


def open_book(folder: str) -> Ledger:
    return Ledger(folder, STEPS, ("planned", "batch:prepared"))
