"""Packs on disk: manifests in TOML, content digests, OCI layouts, a cache."""

from __future__ import annotations

import hashlib
import json
import re
import shutil
import subprocess
import tomllib
from pathlib import Path

_SLUG = re.compile(r"[a-z0-9]+([.-][a-z0-9]+)*")
_SHA = re.compile(r"(sha256:)?[0-9a-f]{64}")
#: Media types and limits in bytes of manifests, layers and packs.
MANIFEST_TYPE = "application/vnd.oci.image.manifest.v1+json"
CONFIG_TYPE = "application/vnd.gleanery.pack.config.v1+toml"
LAYER_TYPE = "application/vnd.gleanery.pack.content.v1"
MOST_MANIFEST, MOST_LAYER, MOST_PACK = 4 << 20, 256 << 20, 1 << 30


def sha256(data: bytes) -> str:
    return "sha256:" + hashlib.sha256(data).hexdigest()


def safe(path: str) -> bool:
    return bool(path) and not path.startswith("/") and "\\" not in path and all(p not in ("", ".", "..") for p in path.split("/"))


def validate(m: dict) -> list[str]:
    """What is wrong with a manifest; nothing if it is in order."""
    wrong = [f"{k} is missing" for k in ("schema", "name", "version", "language", "contents") if k not in m]
    if not _SLUG.fullmatch(str(m.get("name", ""))):
        wrong.append("name is no slug")
    for key in ("provides", "requires"):
        x = m.get(key, [])
        if x != sorted(set(x)):
            wrong.append(f"{key} is not sorted and unique")
    for c in m.get("contents", []):
        if not safe(c.get("path", "")):
            wrong.append(f"path {c.get('path')!r} is not safe")
        if not _SHA.fullmatch(c.get("sha256", "")):
            wrong.append(f"{c.get('path')}: no SHA-256")
    return wrong


def parse(text: str) -> dict:
    m = tomllib.loads(text)
    if wrong := validate(m):
        raise ValueError("; ".join(wrong))
    return m


def to_toml(m: dict) -> str:
    """The one spelling of a manifest: plain keys in order, then its tables."""
    value = lambda v: json.dumps(v, ensure_ascii=False) if not isinstance(v, list) else "[" + ", ".join(map(value, v)) + "]"
    lines = [f"{k} = {value(v)}" for k, v in sorted(m.items()) if not isinstance(v, dict) and not (isinstance(v, list) and v and isinstance(v[0], dict))]
    for k, v in sorted(m.items()):
        for t in [v] if isinstance(v, dict) else v if isinstance(v, list) and v and isinstance(v[0], dict) else []:
            lines += ["", f"[{k}]" if isinstance(v, dict) else f"[[{k}]]", *(f"{a} = {value(b)}" for a, b in sorted(t.items()))]
    return "\n".join(lines) + "\n"


def digest(m: dict) -> str:
    return sha256(to_toml(m).encode())


def verify(m: dict, root: str | Path) -> None:
    for c in m["contents"]:
        p = Path(root, c["path"])
        if p.is_symlink() or not p.resolve().is_relative_to(Path(root).resolve()):
            raise ValueError(f"{c['path']} leaves the pack")
        if sha256(p.read_bytes()).removeprefix("sha256:") != c["sha256"].removeprefix("sha256:"):
            raise ValueError(f"{c['path']} has another digest")


def write_oci(m: dict, root: str | Path, out: str | Path) -> str:
    """An OCI layout, the same bytes for the same pack; returns the manifest's digest."""
    verify(m, root)
    out = Path(out)
    blobs = out / "blobs/sha256"
    blobs.mkdir(parents=True, exist_ok=True)

    def put(data: bytes, kind: str, **more) -> dict:
        d = sha256(data)
        (blobs / d.removeprefix("sha256:")).write_bytes(data)
        return {"mediaType": kind, "digest": d, "size": len(data), **more}

    config = put(to_toml(m).encode(), CONFIG_TYPE)
    layers = [put(Path(root, c["path"]).read_bytes(), LAYER_TYPE, annotations={"org.opencontainers.image.title": c["path"]}) for c in sorted(m["contents"], key=lambda c: c["path"])]
    body = json.dumps({"schemaVersion": 2, "mediaType": MANIFEST_TYPE, "config": config, "layers": layers}, sort_keys=True, separators=(",", ":")).encode()
    top = put(body, MANIFEST_TYPE)
    (out / "oci-layout").write_text('{"imageLayoutVersion":"1.0.0"}')
    (out / "index.json").write_text(json.dumps({"schemaVersion": 2, "manifests": [top]}, sort_keys=True, separators=(",", ":")))
    return top["digest"]


def read_oci(layout: str | Path) -> tuple[dict, dict[str, bytes]]:
    """(manifest, contents) of a layout; every digest, size and title is checked."""
    layout, total = Path(layout), 0

    def blob(d: dict, most: int) -> bytes:
        nonlocal total
        if not re.fullmatch(r"sha256:[0-9a-f]{64}", d["digest"]) or d["size"] > most:
            raise ValueError(f"bad descriptor {d['digest']}")
        data = (layout / "blobs/sha256" / d["digest"].removeprefix("sha256:")).read_bytes()
        total += len(data)
        if len(data) != d["size"] or sha256(data) != d["digest"] or total > MOST_PACK:
            raise ValueError(f"{d['digest']} is not what its descriptor says")
        return data

    (top,) = json.loads((layout / "index.json").read_text())["manifests"]
    body = json.loads(blob(top, MOST_MANIFEST))
    m = parse(blob(body["config"], MOST_MANIFEST).decode())
    contents = {x["annotations"]["org.opencontainers.image.title"]: blob(x, MOST_LAYER) for x in body["layers"]}
    want = {c["path"]: c["sha256"].removeprefix("sha256:") for c in m["contents"]}
    if {p: sha256(d).removeprefix("sha256:") for p, d in contents.items()} != want:
        raise ValueError("layers are not the manifest's contents")
    return m, contents


class Cache:
    """Packs by the digest of their manifests."""

    def __init__(self, root: str | Path):
        self.root = Path(root)
        self.root.mkdir(parents=True, exist_ok=True)

    def add(self, layout: str | Path) -> str:
        m, contents = read_oci(layout)
        d = digest(m)
        at = self.root / d.replace(":", "-")
        if not at.exists():
            part = self.root / (at.name + ".part")
            shutil.rmtree(part, ignore_errors=True)
            for p, data in contents.items():
                (part / p).parent.mkdir(parents=True, exist_ok=True)
                (part / p).write_bytes(data)
            part.mkdir(exist_ok=True)
            (part / "pack.toml").write_text(to_toml(m))
            part.rename(at)
        return d

    def list(self) -> list[tuple[str, dict]]:
        return [(digest(m), m) for p in sorted(self.root.glob("sha256-*/pack.toml")) for m in [parse(p.read_text())]]

    def load(self, d: str, kind: str | None = None) -> list[tuple[str, bytes]]:
        """(path, content) of a pack's contents of a kind, by path."""
        root = self.root / d.replace(":", "-")
        m = parse((root / "pack.toml").read_text())
        verify(m, root)
        return [(c["path"], (root / c["path"]).read_bytes()) for c in sorted(m["contents"], key=lambda c: c["path"]) if kind is None or c.get("kind") == kind]


def run_builder(command: list[str], request: dict, timeout: float = 600) -> dict:
    """An external builder: a JSON request on its standard input, a JSON answer back."""
    p = subprocess.run(command, input=json.dumps(request).encode(), capture_output=True, timeout=timeout)
    if p.returncode:
        raise RuntimeError(f"builder ended with {p.returncode}: {p.stderr.decode(errors='replace')[-500:]}")
    return json.loads(p.stdout)
