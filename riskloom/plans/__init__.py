"""Plans: findings, account risk, rings, and what is read from them."""
