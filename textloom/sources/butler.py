"""The barter agent's server: what it is asked and told over HTTP. Nothing here raises; what fails is null, empty or False."""

from __future__ import annotations

import json
import os
import urllib.parse
import urllib.request

#: Settings by their names in the environment.
ADDRESS, AGENT = "TEXTLOOM_BUTLER_ADDRESS", "TEXTLOOM_AGENT"
#: The address without one, and seconds to wait (fixed values).
HERE, WAIT = "http://127.0.0.1:7719", 5


def alias_of(info: dict) -> str:
    """The alias in the server's answer: its field Alias, a text or the first one with characters in a list."""
    found = info.get("Alias")
    for x in found if isinstance(found, list) else [found]:
        if isinstance(x, str) and x.strip():
            return x.strip()
    return "Desconocido"


class Butler:
    def __init__(self, address: str | None = None, agent: str | None = None, log=lambda message: None):
        self.address = (address or os.environ.get(ADDRESS) or HERE).rstrip("/")
        self.agent, self.log = agent or os.environ.get(AGENT), log

    def _ask(self, method: str, path: str, body: object = None):
        query = f"?{urllib.parse.urlencode({'agente': self.agent})}" if self.agent else ""
        data = None if body is None else json.dumps(body).encode()
        asked = urllib.request.Request(self.address + path + query, data, {"Content-Type": "application/json"}, method=method)
        try:
            with urllib.request.urlopen(asked, timeout=WAIT) as answer:
                got = answer.read()
                return json.loads(got) if got and method == "GET" else True
        except (OSError, ValueError) as e:
            self.log(f"{method} {path}: {e}")
            return None

    def info(self) -> tuple[dict, dict, str, dict] | None:
        """What the agent has and aims at, its alias, and its mailbox by letter id."""
        got = self._ask("GET", "/info")
        return (got.get("Recursos") or {}, got.get("Objetivo") or {}, alias_of(got), got.get("Buzon") or {}) if isinstance(got, dict) else None

    def people(self) -> list[str]:
        got = self._ask("GET", "/gente")
        return [p.get("alias") for p in got if isinstance(p, dict) and p.get("alias")] if isinstance(got, list) else []

    def send_letter(self, sender: str, to: str, subject: str, body: str) -> bool:
        """False also for a letter to oneself, which isn't sent."""
        if (to or "").strip().lower() == (sender or "").strip().lower():
            return False
        return self._ask("POST", "/carta", {"remi": sender, "dest": to, "asunto": subject, "cuerpo": body, "id": "", "fecha": ""}) is not None

    def send_goods(self, sender: str, to: str, goods: dict[str, int]) -> bool:
        if sender and (to or "").strip().lower() == sender.strip().lower():
            return False
        return self._ask("POST", f"/paquete/{urllib.parse.quote(to)}", goods) is not None

    def remove(self, letter: str) -> bool:
        return self._ask("DELETE", f"/mail/{urllib.parse.quote(str(letter))}") is not None
