"""packetlens functions"""
