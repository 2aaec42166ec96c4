"""The analytics: versions, features, findings, reports, checks, logs, documents."""
