"""Thresholds and weights of curation; plain values that become literals in plans."""

from __future__ import annotations

from dataclasses import dataclass, field


# Weights and thresholds on which results depend. Their names here are this project's own.
@dataclass(frozen=True)
class Weights:
    sharpness: float = 0.5
    exposure: float = 0.2
    faces: float = 0.15
    face_sharpness: float = 0.15
    resolution: float = 0.1


@dataclass(frozen=True)
class Curation:
    settle_seconds: float = 120.0
    burst_gap_seconds: float = 10.0
    burst_bits: int = 10
    close_call_margin: float = 0.05
    copy_gap_seconds: float = 1.0
    copy_bits: int = 2
    session_gap_hours: float = 3.0
    match_threshold: float = 0.45
    group_threshold: float = 0.5
    neighbours: int = 10
    weights: Weights = field(default_factory=Weights)


# Where a capture time came from, by how much it tells.
NO_TIME = ("mtime", "folder", "folder-month", "user-day")
UNCERTAIN = ("mtime", "folder-month")

# File kinds by lower-case extension or name.
IMAGE_EXTENSIONS = (".jpg", ".jpeg", ".heic", ".heif", ".png", ".tif", ".tiff", ".gif", ".webp")
VIDEO_EXTENSIONS = (
    ".mov", ".mp4", ".m4v", ".avi", ".3gp", ".mkv", ".mts", ".m2ts", ".wmv", ".mpg", ".mpeg",
    ".mod", ".tod", ".vob", ".webm", ".flv", ".dv",
)
PACKAGE_EXTENSIONS = (".nar",)
SIDECAR_EXTENSIONS = (".thm", ".aae")
JUNK_NAMES = ("thumbs.db", "ehthumbs.db", "desktop.ini", ".ds_store")
EXTENSION_ALIASES = {".jpeg": ".jpg", ".heif": ".heic", ".tiff": ".tif"}

# Folder names of the library layout.
UNDATED, UNKNOWN_DAY, ALTERNATES, DUPLICATES = "_undated", "unknown-day", "_alternates", "_duplicates"
# Fixed value: SHA-256 of no bytes.
EMPTY_SHA256 = "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"
