"""No streaming operators: every query of this engine is a bounded batch."""
