"""Times that several tests share."""

from __future__ import annotations

NOW = 1_776_081_600_000_000_000  # 2026-04-13T12:00:00Z
SECOND = 1_000_000_000
HOUR = 3600 * SECOND
