"""Folder of the given tables for these tests."""

from __future__ import annotations

import os

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
