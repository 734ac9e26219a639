"""Part of the sedimenta engine."""
