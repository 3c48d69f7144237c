"""Small hand-written marketplace tables."""

from __future__ import annotations

from datetime import date, datetime
from decimal import Decimal

from bazaarflow.schemas import BOOKINGS, PROFILES, PROVIDERS


def table(spark, schema, rows):
    """A DataFrame from dicts; missing columns are null."""
    return spark.createDataFrame([tuple(r.get(f.name) for f in schema.fields) for r in rows], schema)


def profiles(spark):
    return table(spark, PROFILES, [
        dict(id="a1", first_name="Sys", last_name="Admin", phone="+91 9999999990", role="admin"),
        dict(id="c1", first_name="Test", last_name="Customer", phone="+91 7777777770", role="customer", area="KK Nagar"),
        dict(id="c2", first_name="Solo", phone=None, email="solo@example.com", role="customer"),
        dict(id="p1", first_name="Pro", last_name="Electrician", phone="+91 8888888880", role="provider",
             area="Thillai Nagar", email="", created_at=datetime(2024, 1, 2)),
        dict(id="p2", first_name="Mani", last_name="Plumbing", phone="", role="provider", area="Srirangam"),
        dict(id="p3", first_name="Raj", last_name="Painters", phone="+91 8888888890", role="provider", area=""),
    ])


def providers(spark):
    return table(spark, PROVIDERS, [
        dict(id="p1", business_name="Fast Fixers 10%", category="Electrician", rating=Decimal("4.90"),
             base_price=Decimal(150), emergency_available=True, status="active", areas_served=["KK Nagar"],
             total_jobs=3, completed_jobs=1),
        dict(id="p2", business_name=None, category="Plumber", rating=None, base_price=None,
             emergency_available=False, status="active", areas_served=None),
        dict(id="p3", business_name="", category="Painter", rating=Decimal("4.90"), base_price=Decimal(400),
             emergency_available=True, status="pending", areas_served=[], joined_date=date(2024, 5, 1)),
        dict(id="p4", business_name="No Profile", category="Plumber", rating=Decimal("4.10"),
             base_price=Decimal(100), emergency_available=None, status="active", areas_served=["KK Nagar", None]),
        dict(id="p5", category="Cleaning", status="pending"),
        dict(id="p6", business_name="Gone", category="Plumber", status="suspended"),
    ])


def bookings(spark):
    def row(i, customer, provider, status, created, price=100, **more):
        return dict(id=f"TF-{i}", customer_id=customer, provider_id=provider, status=status,
                    created_at=created, price=None if price is None else Decimal(price),
                    booking_date=date(2024, 6, i), booking_time="09:00 AM", **more)

    day = datetime(2024, 6, 1)
    return table(spark, BOOKINGS, [
        row(1, "c1", "p1", "completed", day, 250, rating=Decimal(5), description="Fan"),
        row(2, "c1", "p1", "pending", datetime(2024, 6, 3), description="Wiring"),
        row(3, "c2", "p2", "cancelled", datetime(2024, 6, 3)),
        row(4, "gone", "p1", "accepted", None),
        row(5, None, None, "in-progress", None),
        row(6, "c1", "p4", "completed", datetime(2024, 6, 2), None, rating=Decimal(4)),
        row(7, "c2", "p9", "pending", datetime(2024, 5, 1)),
        row(8, None, "p1", "pending", datetime(2024, 5, 2)),
    ])
