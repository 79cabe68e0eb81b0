"""Part of pitframe."""
