"""Keeping the published reports fresh as files arrive."""
