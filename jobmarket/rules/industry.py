"""Keyword groups for the derived industry."""

from __future__ import annotations

# The first group with a keyword inside the text wins; no word boundaries.
INDUSTRY_KEYWORDS: tuple[tuple[str, tuple[str, ...]], ...] = (
    (
        "Information Technology",
        (
            "software", "developer", "programmer", "information technology", "web developer",
            "data analyst", "data scientist", "cybersecurity", "network", "database",
        ),
    ),
    (
        "Banking & Finance",
        ("accountant", "accounting", "finance", "financial", "bank", "audit", "bookkeeper"),
    ),
    (
        "Healthcare",
        ("nurse", "doctor", "medical", "healthcare", "hospital", "pharmac", "therapist"),
    ),
    ("Education", ("teacher", "education", "school", "instructor", "professor")),
    (
        "Sales & Marketing",
        ("sales", "marketing", "business development", "account executive", "brand"),
    ),
    (
        "Construction & Engineering",
        (
            "construction", "civil engineer", "architect", "structural engineer",
            "electrical engineer", "mechanical engineer",
        ),
    ),
    (
        "Hospitality & Tourism",
        ("hotel", "restaurant", "chef", "hospitality", "food service", "housekeeping"),
    ),
    (
        "Logistics & Transportation",
        ("warehouse", "logistics", "driver", "delivery", "transportation", "dispatcher"),
    ),
    ("Retail", ("retail", "store", "cashier", "merchandiser", "sales associate")),
    (
        "Manufacturing",
        ("manufacturing", "production", "factory", "machine operator", "production operator"),
    ),
    ("Real Estate", ("real estate", "property", "leasing")),
)

OTHER_INDUSTRY = "Other"
