"""No streams are part of the work rebuilt here."""
