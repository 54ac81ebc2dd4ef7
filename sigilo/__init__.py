"""Sigilo: detection, resolution, transformation and audit of sensitive data as Spark plans."""
