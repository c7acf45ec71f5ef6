"""Intermediate tables and files in the folder that driver and executors share: the library's."""

from __future__ import annotations

from ..store import shared_dir, shared_file, small, stage

__all__ = ["shared_dir", "shared_file", "small", "stage"]
