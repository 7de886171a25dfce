"""Fixed values of the ledger protocol.

Every hash, key and height below is part of the data format: two copies of a ledger only
compare equal when both sides use exactly these values, so they are stated as they are.
"""

from __future__ import annotations

# --- Fixed values: versions folded into hash preimages -----------------------------------
BLOCK_HASH_VERSION = 1
STATE_HASH_VERSION = 1
STATE_ROOT_VERSION = 1
BLOCK_MERKLE_VERSION = 1
SCHEMA_VERSION = {"indexer": 7, "decoder": 3}

# --- Fixed values: sparse Merkle tree ------------------------------------------------------
SMT_DEPTH = 256
EMPTY_LEAF_TAG = "XCHAIN_EMPTY_LEAF"
BALANCE_DOMAIN = "XCHAIN_BAL"
ESCROW_DOMAIN = "XCHAIN_ESC"
STAKE_DOMAIN = "XCHAIN_STK"
CONTRACT_STATE_DOMAIN = "XCHAIN_CST"
STAKE_TOTAL_PUBKEY = "__total__"
STATE_SUBTREES = (
    "balances_root",
    "stakes_root",
    "ownership_root",
    "tokens_root",
    "contract_state_root",
)
RESERVED_SUBTREES = ("ownership_root", "tokens_root", "contract_state_root")

# --- Fixed values: chain parameters --------------------------------------------------------
GAS_TICK = "XCHAIN"
ACTIVATION_DELAY = {"BTC": 6, "LTC": 24, "DOGE": 60}
STAKE_FLOORS = {
    "price": 1000,
    "cross_chain": 5000,
    "oracle_publish": 500,
    "attestation": 1000,
    "full_node": 2000,
}
VALIDATOR_ROW_LIMIT = 1000
STAKE_MAX_SOURCES = 1000
STAKE_MAX_KEYS_PER_SOURCE = 64
EPOCH_SIZE = 100
MAX_ROLLBACK_DEPTH = 100
PARITY_WINDOW = 100
CHECKPOINT_FRESHNESS_BLOCKS = 500
RECENT_HASH_CAP = 256
STRIKE_THRESHOLD = 3
STRIKE_WINDOW = 200
PAGE_DEFAULT = 50_000
PAGE_MAX = 100_000
LOG_PAGE_MAX = 1000
CHECKPOINT_RANGE_MAX = 2000
BLOCKS_PER_POLL = 100
HASH_CONFIRM_TIMEOUT_MS = 5_000
HEARTBEAT_TTL_MS = 60_000
ARCHIVE_HEAD_VERSIONS = (1, 6)
ARCHIVE_CHUNK_VERSION = 2
OPEN_OFFER_STATUSES = ("open", "cancelling", "expiring")

# --- Fixed values: checkpoint text ---------------------------------------------------------
CHECKPOINT_TAG = "XCHECKPOINT"
EQUIVOCATION_PREFIX = "EQUIV"

# --- Fixed values: feature activation heights, '<COIN>:<network>' first, then bare network --
ACTIVATION_HEIGHTS = {
    "index_map_hash": {"mainnet": 0, "testnet": 0, "regtest": 0},
    "poll_finalize_hash": {
        "BTC:mainnet": 958500, "LTC:mainnet": 3143000, "DOGE:mainnet": 6291000,
        "BTC:testnet": 145000, "LTC:testnet": 4805000, "DOGE:testnet": 67000000,
        "regtest": 0,
    },
    "token_supply_hash": {
        "BTC:mainnet": 958500, "LTC:mainnet": 3143000, "DOGE:mainnet": 6291000,
        "BTC:testnet": 145000, "LTC:testnet": 4805000, "DOGE:testnet": 67000000,
        "regtest": 0,
    },
    "bet_status_hash": {
        "BTC:mainnet": 963000, "LTC:mainnet": 3162000, "DOGE:mainnet": 6338000,
        "BTC:testnet": 0, "LTC:testnet": 0, "DOGE:testnet": 0, "regtest": 0,
    },
    "archive_invalid_hash": {
        "BTC:mainnet": 999999999, "LTC:mainnet": 999999999, "DOGE:mainnet": 999999999,
        "BTC:testnet": 0, "LTC:testnet": 0, "DOGE:testnet": 0, "regtest": 0,
    },
    "archive_height_key": {
        "BTC:mainnet": 999999999, "LTC:mainnet": 999999999, "DOGE:mainnet": 999999999,
        "BTC:testnet": 999999999, "LTC:testnet": 999999999, "DOGE:testnet": 999999999,
        "regtest": 0,
    },
    "state_key_binary": {
        "BTC:mainnet": 962500, "LTC:mainnet": 3160000, "DOGE:mainnet": 6335000,
        "BTC:testnet": 0, "LTC:testnet": 0, "DOGE:testnet": 0, "regtest": 0,
    },
    "equivocation_header": {"mainnet": 961000, "testnet": 0, "regtest": 0},
    "escrow_locked_leaf": {
        "BTC:regtest": 11200, "BTC:testnet": 0, "LTC:testnet": 0, "DOGE:testnet": 0,
    },
}
ACTIVATION_HEIGHTS.update(
    checkpoint_commitment={"mainnet": 961000, "testnet": 146000, "regtest": 0},
    stake_weighted_quorum={"mainnet": 961000, "testnet": 0, "regtest": 0},
    state_commitment={
        "BTC:mainnet": 958500, "LTC:mainnet": 3143000, "DOGE:mainnet": 6291000,
        "BTC:testnet": 145000, "LTC:testnet": 4805000, "DOGE:testnet": 67000000,
        "regtest": 0,
    },
    stake_source_cap={
        "BTC:mainnet": 960000, "LTC:mainnet": 3143000, "DOGE:mainnet": 6291000,
        "BTC:testnet": 0, "LTC:testnet": 0, "DOGE:testnet": 0, "regtest": 0,
    },
    contract_state_root={
        "BTC:regtest": 10000, "BTC:testnet": 0, "LTC:testnet": 0, "DOGE:testnet": 0,
    },
    ownership_root={},
    tokens_root={},
)

# --- Fixed values: protocol addresses that hash as a role token ------------------------------
ADDRESS_ROLES = {
    "1XChainBurnAddressXXXXXXXXXbRsd2N": "BURN",
    "mxchainburnaddressXXXXXXXXXXa8EAfp": "BURN",
    "LXChainBurnAddressXXXXXXXXXXSkrYkJ": "BURN",
    "DChainBurnAddressXXXXXXXXXXXawc9pt": "BURN",
    "nchainburnaddressXXXXXXXXXXXYKgF7W": "BURN",
    "mvs8WdppEhzQLxfcYwrr1eoKA2nUFi55ff": "BURN",
    "1XChain3M4uRwcHqt4XuhVBUQ8cL4qQsA": "GAS",
    "mgassdEpzH2AuKGK9W5FZh8drWYKrpXk6D": "GAS",
    "mgash6jYSKAR3Q5HPpDgNX2BYr18q9N6GQ": "GAS",
    "LXChainCN6yjHVqqS9tYzYVYZ8CCZcSx72": "GAS",
    "mgashLN9oSvj2CUJYKWdNxh6VkamPg1Ges": "GAS",
    "mgas5QYE38Bg34hwEjFKaE7Gs536FARue4": "GAS",
    "DGasfpttCnTijuuoAdiJ9sXJjG7vQ5pMkW": "GAS",
    "ngasn6zHFzJ72zpk3DBKmXhD2XtszujSDW": "GAS",
    "mgasDTdKu5DsbW97qSRnE8raAuYpKMfmhg": "GAS",
    "1Donate1GERVKPW6GFQcnGeTa8dgL6Abyp": "DONATE1",
    "mfztXKX1HeVdCQf6pDCZFEzo5i5wYNHAM6": "DONATE1",
    "muYHF9MMnK6Nmd5zx7EBtqEYZdaf2Xy8JX": "DONATE1",
    "Ldonate18tNZcVThKm5MX33EjvhaanJ6Mg": "DONATE1",
    "mybp5CceJvVV5tNCCiF7oBiZWko2fNkmnT": "DONATE1",
    "mgNY2ZXbnNEkRT5ZRF8yGamivrSX2QH97h": "DONATE1",
    "DDonate1RBcwGnCRNnVtwuCmQyWW1Gn25f": "DONATE1",
    "ndonate1dE87UXUFf4gjyhPg7hfQRJXVXr": "DONATE1",
    "mzdg8wGxgP3Jk45FuZPspumCL3Ruup37ob": "DONATE1",
    "1Donate2LkbBrsanwCVRPWZCXAqQcvcqGz": "DONATE2",
    "myBbbZ4t7BPoyNcT4sHtFwZDuiyYGDXLQM": "DONATE2",
    "mkQd27aJSqsQ666z1Q4MLFmd3Ybqzy3TNw": "DONATE2",
    "Ldonate2io846q2e7q8dUArh3TNnaq9ENb": "DONATE2",
    "muKEjejjXQvLY7Lp7Ecpn29gM2TCb5BLTF": "DONATE2",
    "n2DLJPppXUi8jC6fLiSkthZi2sc9UKiZHd": "DONATE2",
    "DDonate2o3Sg4phybp92oFpkmv8S9ZhGSV": "DONATE2",
    "ndonate2wev8vKDgvd1DHhtJtvkRbn2usJ": "DONATE2",
    "mmXU8RU7q3BUsyT66rtw1H6P7B2ZZd9c5Y": "DONATE2",
    "1rewardsZAyeuLeFJKoAepYiNN5N6uSzn": "REWARD",
    "mrewards4RQFYoZ5yEv4xr12PzfjDYViks": "REWARD",
    "mrewardshQqD1ptkEBZGjPDF77L5uKJQmk": "REWARD",
    "XXXXXXXXXXXXXXXXXXXXXXXXXXXXXXXXXX": "REWARD",
}
